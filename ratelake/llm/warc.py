"""Web archives stored by content: every payload once, exact record headers apart.

An archive is a folder of two tables:

* ``payloads``: (digest, payload), one row for each distinct payload, keyed by its
  SHA-256. Payloads of one digest must agree in length and in SHA-1 or the write fails.
* ``records``: one row for each record with its exact WARC header, the head of its
  block (the HTTP response head), and the digest of its payload.

Of the records of one payload the one of the largest id is the ``response``; the others
are ``revisit`` records that name it. Payloads below ``least`` bytes are always responses.

Reading back joins responses to their payloads, which puts the original record together
byte by byte, takes the digest of what came back, and holds it against the store's key and
the header's own digest; a difference fails the job. Revisits find their facts through the
record they name. Only slim rows meet a digest that many records share: payload bytes are
joined one to one. ``write_files`` and ``read_files`` turn records into plain WARC files and back.

Everything but the file parser is Spark SQL functions, binary data included.

Defined results: a null ``html`` is an empty payload; a null page id is smaller than any
other; among equal ids of one payload exactly one row is the response; a null url leaves
the URI header out, and control characters and spaces of a url are percent-encoded; an empty table gives an
empty archive and result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm.common import saved, small_side
from ratelake.session import scratch_path

# WARC 1.1 names, the base 32 alphabet and the digits of Spark's base 32 conversion.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: twenty bits, five hexadecimal digits, give four characters."""
    digest = F.sha1(data)
    fours = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), DIGITS, ALPHABET)


def _bytes(text: str | Column) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8")


def _urn(*parts: str) -> Column:
    """A record id that follows from these columns."""
    own = F.md5(_bytes(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts])))
    cuts = [F.substring(own, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _safe_uri(url: Column) -> Column:
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _head(columns: list[tuple[str, Column]]) -> Column:
    """A WARC header block with its blank line; fields without a value are left out."""
    fields = [F.concat(F.lit(f"\r\n{name}: "), value.cast("string")) for name, value in columns]
    return F.concat(F.lit(VERSION), F.concat_ws("", *fields), F.lit(END))


def store(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archive of ``pages`` (page_id, url, html) into two tables under ``path``."""
    payload = F.coalesce(F.col("html").cast("binary"), _bytes(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(os.path.join(path, "payloads"))
    # Row numbers only tell equal rows apart; they hold from here on because the table is written.
    slim = saved(
        rows.select(
            "page_id", _safe_uri(F.col("url")).alias("uri"), "digest", base32_sha1(F.col("payload")).alias("sha1"),
            F.octet_length("payload").cast("long").alias("n"), F.monotonically_increasing_id().alias("row"),
        )
    )
    slim = slim.withColumn("record_id", _urn("digest", "page_id", "uri", "row"))
    groups = slim.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max(F.struct("page_id", "row", "uri", "record_id")).alias("first"),
        ((F.min("n") == F.max("n")) & (F.min("sha1") == F.max("sha1"))).alias("same"),
    )
    shared = saved(groups.where("copies > 1").select("digest", "first", "same"))
    unlike = F.raise_error(F.concat(F.lit("unlike payloads of one digest: "), F.col("digest")))
    several = F.when(F.coalesce(F.col("same"), F.lit(True)), F.col("first.row").isNotNull() & (F.col("n") >= least)).otherwise(unlike)
    again = F.col("several") & (F.col("first.row") != F.col("row"))
    rows = slim.join(small_side(shared, shared.count()), "digest", "left").withColumn("several", several.cast("boolean"))
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    of_revisit = lambda value: F.when(F.col("record_type") == "revisit", value)
    length = F.octet_length("http") + F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("n"))
    header = _head(
        [
            ("WARC-Type", F.col("record_type")),
            ("WARC-Record-ID", F.col("record_id")),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.col("uri")),
            ("WARC-Page-ID", F.col("page_id")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
            ("WARC-Profile", of_revisit(F.lit(PROFILE))),
            ("WARC-Refers-To", of_revisit(F.col("first.record_id"))),
            ("WARC-Refers-To-Target-URI", of_revisit(F.col("first.uri"))),
            ("WARC-Refers-To-Date", of_revisit(F.lit(date))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", length),
        ]
    )
    rows = rows.withColumn("http", http).select("digest", "record_type", _bytes(header).alias("header"), _bytes(F.col("http")).alias("http"))
    rows.write.parquet(os.path.join(path, "records"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the exact bytes of every record, put together again, without the two line ends that close it."""
    heads = spark.read.parquet(os.path.join(path, "records"))
    payloads = spark.read.parquet(os.path.join(path, "payloads"))
    wrong = F.raise_error(F.concat(F.lit("payload store: wrong bytes under digest "), F.col("digest")))
    payloads = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))
    lost = F.raise_error(F.concat(F.lit("payload store: nothing under digest "), F.col("digest"))).cast("binary")
    full = heads.where("record_type = 'response'").join(payloads, "digest", "left")
    full = full.select(F.concat("header", "http", F.coalesce("payload", lost)).alias("record"))
    return full.unionAll(heads.where("record_type = 'revisit'").select(F.concat("header", "http").alias("record")))


def parsed(rows: DataFrame) -> DataFrame:
    """The fields of records, ``payload`` being what follows the HTTP head (null for a revisit).

    A record whose length differs from its header, or a payload whose digest does, fails the job.
    """
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    text = rows.select("record", F.col("record").cast("string").alias("whole"))
    text = text.select("record", F.substring_index("whole", END, 1).alias("header"), F.substring_index("whole", END, 2).alias("heads"))
    start = F.octet_length("header") + 4
    rows = text.select(
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("uri"),
        field("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        (F.octet_length("record") - start == field("Content-Length").cast("long")).alias("sound"),
        F.expr("substring(record, octet_length(heads) + 5)").alias("payload"),
    )
    sound = F.col("sound") & ((F.col("record_type") == "revisit") | (base32_sha1(F.col("payload")) == F.col("payload_digest")))
    payload = F.when(F.col("record_type") == "response", F.col("payload"))
    wrong = F.raise_error(F.concat(F.lit("record does not hold what its header says: "), F.col("record_id"))).cast("binary")
    return rows.withColumn("payload", F.when(sound, payload).otherwise(wrong)).drop("sound")


def page_report(rows: DataFrame) -> DataFrame:
    """One row per parsed record: size and digest of the full payload, type, and the page a revisit names."""
    own = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "uri")
    own = saved(own)
    named = own.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    first = own.join(named, "record_id").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest")
    )
    first = saved(first)
    known = own.join(small_side(first, first.count()), "refers_to", "left")
    digest = F.when(F.col("record_type") == "response", F.col("payload_digest")).otherwise(F.col("first_digest"))
    return known.select(
        "page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("first_page").alias("refers_to")
    )


def archive_report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Store ``pages`` by content, read the archive back and report every record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    store(pages, path, least)
    return page_report(parsed(records(spark, path)))


def write_files(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Plain WARC files: a record and the two line ends that close it after another, by Spark's text writer."""
    if files is not None:
        rows = rows.repartition(files)
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).text(path)


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, by the length in each header; an error if the file is not sound."""
    at = 0
    while at < len(data):
        head = data.find(END.encode(), at)
        length = re.search(rb"\r\nContent-Length: *(\d+)\r\n", data[at : head + 2], re.I)
        if not data.startswith(b"WARC/", at) or head < 0 or length is None:
            raise ValueError(f"no WARC record at byte {at}")
        end = head + 4 + int(length[1])
        if data[end : end + 4] != END.encode():
            raise ValueError(f"the WARC record at byte {at} does not end where its length says")
        yield data[at:end]
        at = end + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of plain WARC files. A file is read whole by one task: keep files well under 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for record in split_records(data.as_py()):
                    yield pa.RecordBatch.from_pydict({"record": pa.array([record], pa.binary())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(run, "record binary")


def oracle_sql(table: str = "pages") -> str:
    """The same report by grouping the texts themselves."""
    digits = " || ".join(f"substr(alphabet, (v // {32 ** (3 - j)} % 32) + 1, 1)" for j in range(4))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM {table}),
h AS (SELECT page_id, payload, sha1(payload) AS hex, '{ALPHABET}' AS alphabet FROM p),
d AS (
  SELECT page_id, payload, list_aggregate(list_transform(range(8), lambda i: list_extract(list_transform([CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)],
    lambda v: {digits}), 1)), 'string_agg', '') AS payload_digest
  FROM h
),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM d)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""
