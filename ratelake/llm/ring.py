"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of the ring; a row belongs to the first point
clockwise of its key's hash. A shard takes at most its capacity; what overflows
continues clockwise to the next point whose shard has room. The ring is a grid of
``2**GRID_BITS`` buckets, so the loads that decide overflow are one count per
(bucket, salt): at most ``2**GRID_BITS * SALTS`` rows, whatever the input. Rows
are ranked only inside their own cell, so no task sees a whole arc or shard.

Defined results: a null key hashes like any other value; rows that share a key
share a ring bucket and are told apart by their text; equal rows are
interchangeable; an empty table gives an empty result; a null text has size 8
and checksum 0. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelake.llm.common import inline_table, top_bits, with_plain_names, without

GRID_BITS = 12
SALTS = 4
VNODES = 40


def ring_points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Sorted (bucket, shard), one shard per bucket: where two meet, the smaller shard stays."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard-{shard}/{v}".encode()).digest()
            bucket = int.from_bytes(digest[:4], "big") >> (32 - GRID_BITS)
            points[bucket] = min(shard, points.get(bucket, shard))
    return sorted(points.items())


def capacities(total: int, shards: int, epsilon: float) -> list[int]:
    """Rows a shard may take: exactly the even split for ``epsilon`` 0, else (1 + epsilon) times the mean."""
    if epsilon > 0:
        return [math.ceil(total * (1 + epsilon) / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def place(
    cells: list[tuple[int, int, int]], points: list[tuple[int, int]], caps: list[int]
) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (bucket, salt, first rank, end rank, shard, first slot) for cells (bucket, salt, rows).

    First every shard takes the rows of its own arcs, in ring order, up to its
    capacity; then the overflow of each cell walks on clockwise.
    """
    buckets = [b for b, _ in points]
    n = len(points)
    used = [0] * len(caps)
    ahead = list(range(n))  # ahead[i]: the next point from i on that may still have room

    def with_room(i: int) -> int:
        trail = []
        while used[points[i][1]] >= caps[points[i][1]]:
            trail.append(i)
            step = ahead[i] if ahead[i] != i else (i + 1) % n
            i = step
            if len(trail) > n:
                raise ValueError("the shards' capacities are below the number of rows")
        for j in trail:
            ahead[j] = i
        return i

    out, over = [], []
    for bucket, salt, rows in cells:
        at = bisect_left(buckets, bucket) % n
        shard = points[at][1]
        take = min(rows, caps[shard] - used[shard])
        if take:
            out.append((bucket, salt, 0, take, shard, used[shard]))
            used[shard] += take
        if take < rows:
            over.append((at, bucket, salt, take, rows))
    for at, bucket, salt, rank, rows in over:
        while rank < rows:
            at = with_room(at)
            shard = points[at][1]
            take = min(rows - rank, caps[shard] - used[shard])
            out.append((bucket, salt, rank, rank + take, shard, used[shard]))
            used[shard] += take
            rank += take
    return out


def assign(
    docs: DataFrame, shards: int = 24, epsilon: float = 0.0, key: str = "doc_id", text: str = "text", vnodes: int = VNODES
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return with_plain_names(docs, lambda rows: _assign(rows, shards, epsilon, key, text, vnodes))


def _assign(docs: DataFrame, shards: int, epsilon: float, key: str, text: str, vnodes: int) -> DataFrame:
    body = without(docs, "shard", "slot")
    hashed = F.xxhash64(F.col(key))
    cell = [
        top_bits(hashed, GRID_BITS).alias("__bucket"),
        F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int").alias("__salt"),
    ]
    counts = docs.select(*cell).groupBy("__bucket", "__salt").count().collect()  # bounded by the grid
    cells = sorted((r["__bucket"], r["__salt"], r["count"]) for r in counts)
    total = sum(c for _, _, c in cells)
    segments = place(cells, ring_points(shards, vnodes), capacities(total, shards, epsilon))
    table = inline_table(
        docs.sparkSession,
        "__b:int,__s:int,__lo:bigint,__hi:bigint,shard:int,__first:bigint",
        (f'{{"__b":{b},"__s":{s},"__lo":{lo},"__hi":{hi},"shard":{shard},"__first":{first}}}' for b, s, lo, hi, shard, first in segments),
    )
    order = Window.partitionBy("__bucket", "__salt").orderBy("__h", F.col(key), "__t")
    ranked = body.select("*", *cell, hashed.alias("__h"), F.xxhash64(F.col(text)).alias("__t")).withColumn(
        "__rank", F.row_number().over(order) - 1
    )
    # The segment table has at most one row per grid cell plus one per shard and overflow step: safe to broadcast.
    joined = ranked.join(
        F.broadcast(table),
        (F.col("__bucket") == F.col("__b"))
        & (F.col("__salt") == F.col("__s"))
        & (F.col("__rank") >= F.col("__lo"))
        & (F.col("__rank") < F.col("__hi")),
    )
    return joined.select(
        *[F.col(f"`{c}`") for c in body.columns], "shard", (F.col("__first") + F.col("__rank") - F.col("__lo")).alias("slot")
    )


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: id, size, checksum, law, shard and slot under the ``rows`` law."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return assign(slim, shards=shards, text="text_crc32").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
