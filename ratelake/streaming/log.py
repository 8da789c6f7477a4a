"""A stored message log and its streaming source.

A log is a Parquet table of messages with a partition and a gapless offset each, written in
segments, and a small index file for every segment that says which file holds which offsets::

    <log>/segment=<n>/*.parquet     partition, offset, key, value, timestamp
    <log>/_index/<n>.json           [{file, partition, first, last}]

A segment counts once its index file is there. ``append_messages`` writes one; the source
``message_log`` (Spark's Python Data Source API) reads the log as a stream with a position per
partition, starting at the ``earliest`` or the ``latest`` offset. Tasks read only files, and of
these only row groups, that hold their offsets.

``maxOffsetsPerTrigger`` bounds a micro-batch; it is dealt over the partitions by what each still
holds. Spark asks a Python source how far a batch may go without saying where it starts, so a
bounded reader notes how far it has gone under ``<log>/_groups/<group>.json``; its ``group`` belongs
to one checkpoint. Which messages are read is up to the checkpoint alone: the note only sizes batches, and
it is written before an offset is handed out, so no batch ends before it starts.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ratelake.sources import files as FS

FORMAT = "message_log"
RANGE_ROWS = 1 << 18  # messages that one task sorts: about 100 MB
SPAN_ROWS = 1 << 17  # messages that one task reads
ROW_GROUP_BYTES = 8 << 20
SCHEMA = "partition int, offset long, key binary, value binary, timestamp timestamp"


def _indexes(spark: SparkSession, path: str) -> list[str]:
    return FS.matching(spark, f"{path}/_index/*.json")


def log_ends(spark: SparkSession, path: str) -> dict[int, int]:
    """The next offset of every partition that holds messages."""
    ends: dict[int, int] = {}
    for index in _indexes(spark, path):
        for entry in FS.read_json(spark, index):
            ends[entry["partition"]] = max(ends.get(entry["partition"], 0), entry["last"] + 1)
    return ends


def append_messages(messages: DataFrame, path: str, partitions: int = 4, order_by: tuple[str, ...] = ()) -> int:
    """Append ``messages`` (value, and key and timestamp where present) as one segment; returns its number.

    Messages of one key go to one partition, in the order of ``order_by`` (then key and value);
    messages without a key are dealt by their value. A partition's offsets go on where it ended. The
    messages are sorted in ranges of about ``RANGE_ROWS``, the ranges counted, and their rows numbered from
    there, so the tasks grow with the messages and not with the partitions. Of two appends at once one fails and leaves no trace in the index.
    """
    spark = messages.sparkSession
    taken = _indexes(spark, path)
    number = 1 + max((int(posixpath.basename(p)[:-5]) for p in taken), default=-1)
    ends = log_ends(spark, path)
    column = lambda c, t: (F.col(c) if c in messages.columns else F.lit(None)).cast(t).alias(c)
    rows = messages.select(column("key", "binary"), column("value", "binary"), column("timestamp", "timestamp"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order_by)])
    rows = rows.withColumn("partition", F.pmod(F.xxhash64(F.coalesce("key", "value")), F.lit(partitions)).cast("int"))
    # Equal messages are told apart by their place in the input, so that a range is never larger for their sake.
    order = ["partition", *[f"_by{i}" for i in range(len(order_by))], "key", "value", "_tie"]
    ranges = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranges = ranges.repartitionByRange(max(1, -(-rows.count() // RANGE_ROWS)), *order).sortWithinPartitions(*order).persist()
    folder = f"{path}/segment={number:08d}"
    try:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number inside its range
        numbered = ranges.withColumns({"_range": F.spark_partition_id(), "_row": place})
        sizes = numbered.groupBy("_range", "partition").agg(F.min("_row").alias("low"), F.count(F.lit(1)).alias("n"))
        bases = []
        for r in sorted(sizes.collect(), key=lambda r: (r["partition"], r["_range"])):  # a row a range and partition
            bases.append({"_range": r["_range"], "partition": r["partition"], "_base": ends.get(r["partition"], 0) - r["low"]})
            ends[r["partition"]] = ends.get(r["partition"], 0) + r["n"]
        kinds = pa.schema([("_range", pa.int32()), ("partition", pa.int32()), ("_base", pa.int64())])
        base = F.broadcast(spark.createDataFrame(pa.Table.from_pylist(bases, kinds)))
        placed = numbered.join(base, ["_range", "partition"]).withColumn("offset", F.col("_row") + F.col("_base"))
        # Offsets stay sorted within a file, so row groups have narrow offset ranges.
        writer = placed.select("partition", "offset", "key", "value", "timestamp").write.mode("overwrite")
        writer.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    finally:
        ranges.unpersist()
    held = spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"), "partition")
    entries = held.agg(F.min("offset").alias("first"), F.max("offset").alias("last")).collect()  # one row per file and partition
    FS.write_json(spark, f"{path}/_index/{number:08d}.json", sorted((r.asDict() for r in entries), key=lambda e: (e["partition"], e["first"])))
    return number


class _Span(InputPartition):
    """Offsets ``first`` to ``last`` of a partition inside one file."""

    def __init__(self, file: str, partition: int, first: int, last: int):
        self.file, self.partition, self.first, self.last = file, partition, first, last


def _opened(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class LogReader(DataSourceStreamReader):
    """Positions are ``{partition: next offset}`` with partitions as text (offsets are kept as JSON)."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("the message log needs a path")
        self.path = options["path"].rstrip("/")
        self.starting = options.get("startingoffsets", "latest")
        if self.starting not in ("earliest", "latest"):
            raise ValueError("startingOffsets must be earliest or latest")
        self.most, self.group = int(options.get("maxoffsetspertrigger", 0)), options.get("group")
        if self.most and not self.group:
            raise ValueError("maxOffsetsPerTrigger needs a group, one for each checkpoint")
        self.known: dict[str, list[dict[str, Any]]] = {}

    def _entries(self) -> list[dict[str, Any]]:
        """All index entries; an index file never changes, so each is read once."""
        from pyarrow import fs

        store, folder = _opened(f"{self.path}/_index")
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.path not in self.known and info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with store.open_input_stream(info.path) as stream:
                    self.known[info.path] = json.loads(stream.read())
        return [e for path in sorted(self.known) for e in self.known[path]]

    def _ends(self) -> dict[str, int]:
        ends: dict[str, int] = {}
        for e in self._entries():
            ends[str(e["partition"])] = max(ends.get(str(e["partition"]), 0), e["last"] + 1)
        return ends

    def initialOffset(self) -> dict[str, int]:  # noqa: N802 - the API's name
        return {} if self.starting == "earliest" else self._ends()

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        ends = self._ends()
        if not self.most:
            return ends
        store, note = _opened(f"{self.path}/_groups/{self.group}.json")
        if store.get_file_info(note).is_file:
            with store.open_input_stream(note) as stream:
                gone = json.loads(stream.read())
        else:
            gone = self.initialOffset()
        left = {p: e - gone.get(p, 0) for p, e in ends.items()}
        total = sum(left.values())
        if total > self.most:
            share = {p: n * self.most // total for p, n in left.items()}
            for p in sorted(left, key=lambda p: share[p] - left[p])[: self.most - sum(share.values())]:
                share[p] += 1
            ends = {p: gone.get(p, 0) + n for p, n in share.items()}
        if ends != gone:
            store.create_dir(posixpath.dirname(note), recursive=True)
            with store.open_output_stream(f"{note}.new") as stream:
                stream.write(json.dumps(ends).encode())
            store.move(f"{note}.new", note)
        return ends

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[_Span]:
        spans = []
        for e in self._entries():
            first, last = max(e["first"], start.get(str(e["partition"]), 0)), min(e["last"], end.get(str(e["partition"]), 0) - 1)
            for at in range(first, last + 1, SPAN_ROWS):
                spans.append(_Span(e["file"], e["partition"], at, min(last, at + SPAN_ROWS - 1)))
        return spans

    def read(self, partition: _Span) -> Iterator[Any]:
        import pyarrow.dataset as ds

        store, file = _opened(partition.file)
        own = (ds.field("partition") == partition.partition) & (ds.field("offset") >= partition.first) & (ds.field("offset") <= partition.last)
        schema = pa.schema(
            [("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC"))]
        )
        for batch in ds.dataset(file, filesystem=store, format="parquet").to_batches(columns=schema.names, filter=own):
            yield batch.cast(schema)

    def commit(self, end: dict[str, int]) -> None:
        """Nothing to let go: a log keeps its messages."""

    def stop(self) -> None:
        self.known = {}


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").option("path", ...)``; options ``startingOffsets``, ``maxOffsetsPerTrigger``.

    ``latest`` is the default, as for a message broker; ``maxOffsetsPerTrigger`` needs a ``group``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> LogReader:  # noqa: N802
        return LogReader(dict(self.options))


def register(spark: SparkSession) -> str:
    """Make the source known to the session; returns its format name."""
    spark.dataSource.register(MessageLog)
    return FORMAT
