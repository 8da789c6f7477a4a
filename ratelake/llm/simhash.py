"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingle hashes do. For
radius r, ``2**(r+1) - 1`` masks are built from one (r+1)-bit vector per
fingerprint bit: mask v holds the bits whose vector has an odd inner product with
v. Any r bits leave some mask free of all of them, so two fingerprints that
differ in at most r bits agree under that mask and collide in its table.

Copies are reduced to one row per fingerprint before hashing. A bucket of two
gives its pair from plain aggregates; larger buckets are split into blocks of
bounded size, and each pair of blocks gives only a spanning forest of its links.
Links are joined into components.

``drop_near_duplicates`` keeps one row of each component.

Defined results: a null or empty text has no words and fingerprint zero, linked
like any other; equal rows share a component; a null ``doc_id`` never becomes a
component id unless nothing else is reachable; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.llm.common import free_name, saved, small_side
from ratelake.llm.components import connected_components

BLOCK = 256  # members of a bucket that are compared at once
CHUNK = 1 << 15  # shingles unpacked at once


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of which, for any ``radius`` bits, at least one holds none of them."""
    span = (1 << (radius + 1)) - 1
    vector = [i % span + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vector) if (m & v).bit_count() & 1) for v in range(1, span + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by a space (fewer words: of all of them)."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter(
        (digest(joined[i:j], seed) for i, j in zip(start[:n].tolist(), end[width - 1 :].tolist(), strict=True)), np.uint64, n
    )


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in more than half of ``hashes``; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    out = np.packbits(counts * 2 > len(hashes))
    return int.from_bytes(out.tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64-bit) of every row, and the long columns to ``keep``."""
    names = ["doc_id", *keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(majority(shingle_hashes(words_of(t.as_py()), width, seed))) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col(text).cast("binary").alias("t"))
    return own.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """Links (a, b, bits) of a minimum spanning forest over pairs at most ``radius`` bits apart."""
    v = values.view(np.uint64)
    gap = np.bitwise_count(v[:, None] ^ v[None, :])
    i, j = np.nonzero(np.triu(gap <= radius, 1))
    d = gap[i, j]
    parent = list(range(len(v)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(d, kind="stable").tolist():
        x, y = find(int(i[k])), find(int(j[k]))
        if x != y:
            parent[x] = y
            out.append((int(values[i[k]]), int(values[j[k]]), int(d[k])))
    return out


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Spanning links (a, b) between distinct ``fp`` at most ``radius`` bits apart. ``prints``: one row per ``fp``."""
    masks = [signed(m) for m in covering_masks(radius)]
    tables = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)]))
    rows = prints.select("fp", tables.alias("bucket"))
    # Nearly every bucket holds one row, so rows are shuffled as they are, without partial sums.
    sizes = rows.repartition("bucket").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    full = saved(sizes.where("n > 1"))
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = full.where("n = 2").where(bits <= radius).select("a", "b")
    large = full.where("n > 2").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = rows.join(small_side(large, large.count()), "bucket").withColumn("own", own).withColumn("other", other)
    sets = (
        member.groupBy("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # two blocks: bounded by about 2 * BLOCK
        .select("fps")
        .distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [link for fps in batch.column("fps") for link in forest(fps.values.to_numpy(), radius)]
            a, b = ([link[k] for link in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.unionAll(sets.mapInArrow(run, "a long, b long")).distinct()


def _lookup(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of every fingerprint that several rows or a link share; ``component_id`` is the smallest doc_id."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    found = links(classes.select("fp"), radius)
    labels = saved(connected_components(found).withColumnRenamed("node", "fp"))
    members = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = members.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("k")), "label", "left").where("n > 1 OR k > 1")
    lows = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    return saved(linked.select("fp", "label").join(lows, "label").select("fp", "component_id", "label"))


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Every row's doc_id, fingerprint (hex) and component_id (smallest doc_id reachable)."""
    prints = saved(fingerprints(docs, width, seed))
    lookup = _lookup(prints, radius)
    return prints.join(small_side(lookup, lookup.count()), "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row (but for maps): rows that agree in both are one row repeated."""
    plain = [f"`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.xxhash64(F.lit(salt), *plain) for salt in (1, 2)]


def drop_near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null ids last, ties by row hash).

    A row repeated in whole stays once. Rows that go are named by a 128-bit hash of the row.
    """
    k1, k2 = free_name(docs, "k1"), free_name(docs, "k2")
    keys = _row_keys(docs)
    rows = docs.select("doc_id", "text", keys[0].alias("k1"), keys[1].alias("k2"))
    prints = saved(fingerprints(rows, width, seed, keep=("k1", "k2")))
    lookup = _lookup(prints, radius).select("fp", "label")
    member = saved(prints.join(small_side(lookup, lookup.count()), "fp").select("label", "doc_id", "k1", "k2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("k1").alias("a"), F.col("k2").alias("b"))
    stays = saved(member.groupBy("label").agg(F.min(order).alias("stay")).select("label", "stay.a", "stay.b"))
    held = member.join(small_side(stays, stays.count()), "label").withColumn("stay", (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")))
    held = held.groupBy("k1", "k2").agg(F.max("stay").alias("stay"), F.count(F.lit(1)).alias("n"))
    fate = saved(held.where("NOT stay OR n > 1").select(F.col("k1").alias(k1), F.col("k2").alias(k2), "stay"))
    n = fate.count()
    own = (keys[0] == F.col(k1)) & (keys[1] == F.col(k2))
    single = docs.join(small_side(fate.select(k1, k2), n), own, "left_anti")
    again = fate.where("stay").select(k1, k2)
    again = docs.join(small_side(again, n), own)
    once = again.groupBy(k1, k2).agg(F.first(F.struct(*[f"`{c}`" for c in docs.columns])).alias("row")).select("row.*")
    return single.unionAll(once)
