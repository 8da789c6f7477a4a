"""Repeated byte strings by sparse suffix order and longest-previous-factor runs.

A string of ``length`` bytes is repeated if it also starts at another place of the
corpus, the same document included. Every window of that length has one anchor:
the position of its smallest k-gram hash, which depends on the window's content
alone, so equal windows have equal anchors at equal offsets. Consecutive windows
with one anchor form a segment.

1. Anchors that occur once in the corpus are dropped: none of their windows repeats.
2. The segments of the other anchors meet by anchor. Equal segments are reduced to
   one row first, so copies cost no more than their first.
3. Inside an anchor's group the segments are sorted forwards and backwards from the
   anchor: two sparse suffix orders. Windows at offset o are equal exactly if they
   share a run of forward LCP >= length - o and a run of backward LCP >= o. The
   smallest position of such a class is the previous smaller position for all
   others: their longest previous factor reaches ``length``; the class's first
   member has none.
4. ``keep="first"`` removes every window with an earlier match (the first copy
   stays); ``keep="none"`` removes every repeated window.

Whole-document copies are recognised by hash and never compared. An anchor with more
than ``HOT`` segments is not gathered: its segments are reduced to distinct ones and
their windows hashed and counted by Spark one by one instead, which is exact too.
Texts are shuffled only where the anchors or runs they meet are too many to broadcast.

Defined results: texts are UTF-8 bytes, a null text is empty; matches never cross
documents; equal rows are copies of one another; with ``keep="first"`` the first
copy is that of the smallest (doc_id, position), null ids last; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.llm.common import saved
from ratelake.session import scratch_path

GRAM = 64
PIECE = 1 << 18  # window starts hashed at once: about 50 MB of arrays in a task
HOT = 1 << 14  # segments of one anchor that are compared in one task: tens of MB
POS_BITS = 22
MAX_BROADCAST_ENTRIES = 4_000_000  # numbers in a side that is broadcast
_MASK = np.uint64((1 << POS_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64; made once per task."""
    n = 2 * PIECE + (1 << 16)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return up, down


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _segments_of_buffer(
    buf: bytes, length: int, powers: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of windows with one anchor: first start, last start, anchor position, anchor hash."""
    up, down = powers
    b = np.frombuffer(buf, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(b)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(b * up[:n], out=h[1:])
    g = (h[GRAM:] - h[:-GRAM]) * down[: n - GRAM + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    at = _sliding_min((g & ~_MASK) | np.arange(len(g), dtype=np.uint64), length - GRAM + 1) & _MASK
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    return first, last, at[first].astype(np.int64), g[at[first].astype(np.int64)].view(np.int64)


def segments(
    texts: list[bytes], length: int, powers: tuple[np.ndarray, np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, first starts, last starts, anchor positions, anchor hashes) of each text, piece by piece."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        first, last, at, hashes = _segments_of_buffer(b"".join(p for _, _, p in pieces), length, powers)
        begin = 0
        for i, offset, p in pieces:
            # Runs are cut at a piece's ends; windows that reach into the next piece are not windows.
            lo, hi = np.searchsorted(last, begin), np.searchsorted(first, begin + len(p) - length, "right")
            f = np.maximum(first[lo:hi], begin) - begin
            e = np.minimum(last[lo:hi], begin + len(p) - length) - begin
            yield i, f + offset, e + offset, at[lo:hi] - begin + offset, hashes[lo:hi]
            begin += len(p)

    for i, t in enumerate(texts):
        for offset in range(0, len(t) - length + 1, PIECE):
            p = t[offset : offset + PIECE + length - 1]
            pieces.append((i, offset, p))
            held += len(p)
            if held >= PIECE:
                yield from flush()
                pieces, held = [], 0
    if pieces:
        yield from flush()


def _lcp(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; the first has none."""
    differ = rows[1:] != rows[:-1]
    found = differ.argmax(axis=1)
    found[~differ.any(axis=1)] = rows.shape[1]
    return np.r_[-1, found]


def _sorted_runs(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, bytes), and the LCP with the row before (-1 at a group's start)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    common = _lcp(rows[order])
    common[np.r_[True, group[order][1:] != group[order][:-1]]] = -1
    return order, common


def repeated_windows(
    group: np.ndarray, strings: list[bytes], offsets: np.ndarray, rank: np.ndarray, length: int, keep: str
) -> list[list[tuple[int, int]]]:
    """Per segment, the inclusive ranges of its window starts that repeat in another segment of its group.

    ``offsets``: the anchor's place in each string; ``rank``: the segments in text
    order. With ``keep="first"`` only windows with an earlier match are listed.
    """
    n = len(strings)
    most = int(offsets.max())
    fore, back = np.zeros((n, length), np.uint8), np.zeros((n, max(most, 1)), np.uint8)
    for i, s in enumerate(strings):
        o = int(offsets[i])
        right = s[o : o + length]
        fore[i, : len(right)] = np.frombuffer(right, np.uint8)
        if o:
            back[i, :o] = np.frombuffer(s[:o][::-1], np.uint8)
    size = np.array([len(s) for s in strings])
    f_order, f_lcp = _sorted_runs(fore, group)
    b_order, b_lcp = _sorted_runs(back, group)
    hit = np.zeros((n, most + 1), bool)  # by bytes before the anchor
    f_run, b_run = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        own = np.flatnonzero((offsets >= o) & (size - offsets >= length - o))
        if len(own) < 2:
            continue
        f_run[f_order] = np.cumsum(f_lcp < length - o)
        b_run[b_order] = np.cumsum(b_lcp < o)
        key = f_run[own] * (n + 1) + b_run[own]
        order = np.lexsort((rank[own], key))
        k = key[order]
        same = k[1:] == k[:-1]
        flag = np.zeros(len(own), bool)
        flag[order[1:]] |= same
        if keep == "none":
            flag[order[:-1]] |= same
        hit[own[flag], o] = True
    out: list[list[tuple[int, int]]] = []
    for i in range(n):
        o = int(offsets[i])
        starts = hit[i, : o + 1][::-1]  # window start = anchor offset - bytes before the anchor
        edge = np.flatnonzero(np.diff(np.r_[0, starts.view(np.int8), 0]))
        out.append([(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _digest(*cols: Column | str) -> list[Column]:
    """A 128-bit content hash as two longs."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def removed_runs(docs: DataFrame, length: int, keep: str) -> tuple[DataFrame, DataFrame]:
    """(copies: h1, h2, n, first id) of texts held by several rows, and (h1, h2, runs) of every
    distinct text's byte runs [start, end) to remove. ``docs``: doc_id, t (bytes), h1, h2."""
    spark = docs.sparkSession
    long_enough = F.octet_length("t") >= length
    copies = saved(
        docs.where(long_enough).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    )
    marked = docs.where(long_enough).join(_fits(copies, 4 * copies.count()), ["h1", "h2"], "left")
    reps = marked.where(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("low")))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in _slices(batches):
            texts = batch.column("t").to_pylist()
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            for i, _, _, _, hashes in segments(texts, length, powers):
                value, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"h1": np.full(len(value), h1[i]), "h2": np.full(len(value), h2[i]), "anchor": value, "n": n}
                )

    seen = reps.select("t", "h1", "h2").mapInArrow(anchors, "h1 long, h2 long, anchor long, n long")
    seen = spark.read.schema(seen.schema).parquet(_write(seen, "lpf-anchors"))
    again = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = saved(seen.join(again, "anchor").groupBy("h1", "h2").agg(F.collect_set("anchor").alias("anchors")))
    entries = wanted.agg(F.sum(2 + F.size("anchors"))).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in _slices(batches):
            texts = batch.column("t").to_pylist()
            ids, h1, h2 = (batch.column(c) for c in ("doc_id", "h1", "h2"))
            want = [np.sort(np.array(a.as_py(), np.int64)) for a in batch.column("anchors")]
            for i, first, last, at, hashes in segments(texts, length, powers):
                place = np.minimum(np.searchsorted(want[i], hashes), len(want[i]) - 1)
                rows: dict[tuple[int, int, bytes], list[int]] = {}
                for s, e, p, h in zip(*(x[want[i][place] == hashes].tolist() for x in (first, last, at, hashes)), strict=True):
                    rows.setdefault((h, p - s, texts[i][s : e + length]), []).append(s)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in rows], pa.int64()),
                        pa.array([k[1] for k in rows], pa.int32()),
                        pa.array([k[2] for k in rows], pa.binary()),
                        pa.array(list(rows.values()), pa.list_(pa.int64())),
                        pa.array([ids[i].as_py()] * n, pa.int64()),
                        pa.array([h1[i].as_py()] * n, pa.int64()),
                        pa.array([h2[i].as_py()] * n, pa.int64()),
                    ],
                    names=["anchor", "o", "s", "starts", "doc_id", "h1", "h2"],
                )

    found = reps.select("doc_id", "t", "h1", "h2").join(_fits(wanted, entries), ["h1", "h2"])
    parts = found.mapInArrow(cut, "anchor long, o int, s binary, starts array<long>, doc_id long, h1 long, h2 long")
    parts = parts.withColumns(dict(zip(("k1", "k2"), _digest("anchor", "o", "s"), strict=True)))
    path = _write(parts, "lpf-segments")
    parts = spark.read.schema(parts.schema).parquet(path)
    # Positions in text order: null ids last.
    place = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), "h1", "h2", F.element_at("starts", 1).alias("a"))
    same = saved(
        parts.groupBy("anchor", "k1", "k2").agg(F.sum(F.size("starts")).alias("n"), F.count(F.lit(1)).alias("m"), F.min(place).alias("first"))
    )
    plural = saved(same.groupBy("anchor").agg(F.count(F.lit(1)).alias("g"), F.sum("m").alias("m")).where("g > 1"))
    calm, hot = plural.where(F.col("m") <= HOT).select("anchor"), plural.where(F.col("m") > HOT).select("anchor")
    # The strings are shuffled once, by anchor; of equal segments the first in text order stays.
    one = F.row_number().over(Window.partitionBy("anchor", "k1", "k2").orderBy("place"))
    cold = (
        parts.select("anchor", "k1", "k2", "o", "s", place.alias("place"))
        .join(calm.hint("merge"), "anchor")
        .withColumn("r", one)
        .where("r = 1")
        .sortWithinPartitions("anchor", "place")
        .select("anchor", "k1", "k2", "o", "s")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            # Rows come in text order inside a group, so the row number is the rank.
            ranges = repeated_windows(
                t.column("anchor").to_numpy(), t.column("s").to_pylist(), t.column("o").to_numpy().astype(np.int64),
                np.arange(t.num_rows), length, keep,
            )
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks() for c in ("k1", "k2")), pa.array(ranges, kind)], names=["k1", "k2", "ranges"]
            )

    ranged = cold.mapInArrow(compare, "k1 long, k2 long, ranges array<array<long>>")
    n_hot = hot.count()
    if n_hot:
        strings = parts.join(_fits(hot, n_hot), "anchor").groupBy("anchor", "k1", "k2").agg(F.first("s").alias("s"))
        ranged = ranged.unionAll(_hashed_windows(strings, same, length, keep))
    result = same.join(ranged, ["k1", "k2"], "left").where((F.col("n") > 1) | (F.size("ranges") > 0))
    every = lambda c: F.array(F.array(F.lit(0).cast("long"), c))
    merged = parts.select("k1", "k2", "doc_id", "h1", "h2", "starts", (F.octet_length("s") - length).cast("long").alias("end")).join(
        result.select("k1", "k2", "n", "first", "ranges"), ["k1", "k2"]
    )
    whole = F.col("n") > 1
    rows = merged.select("h1", "h2", "first", "n", "ranges", "end", F.explode("starts").alias("a"))
    if keep == "first":
        mine = (F.col("first.h1") == F.col("h1")) & (F.col("first.h2") == F.col("h2")) & (F.col("first.a") == F.col("a"))
        whole = whole & ~mine
    lists = F.when(whole, every(F.col("end"))).otherwise(F.coalesce("ranges", F.array().cast("array<array<long>>")))
    spans = rows.select("h1", "h2", "a", F.explode(lists).alias("r")).select(
        "h1", "h2", F.struct((F.col("a") + F.col("r")[0]).alias("x"), (F.col("a") + F.col("r")[1] + length).alias("y")).alias("r")
    )
    by_text = spans.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("r")).alias("runs"))  # one text's own segments

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [merged_runs([(r["x"], r["y"]) for r in one]) for one in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), pa.array(runs, pa.list_(pa.list_(pa.int64())))], names=["h1", "h2", "runs"]
            )

    return copies, saved(by_text.mapInArrow(joined, "h1 long, h2 long, runs array<array<long>>"))


def _hashed_windows(texts: DataFrame, same: DataFrame, length: int, keep: str) -> DataFrame:
    """The ranges of very large anchor groups: every window hashed (128 bits) and counted on its own."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, s in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "s")), strict=True):
                n = len(s) - length + 1
                digests = np.array(
                    [hashlib.blake2b(s[a : a + length], digest_size=16).digest() for a in range(n)], "S16"
                )
                raw = np.frombuffer(digests.tobytes(), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict(
                    {"k1": np.full(n, k1), "k2": np.full(n, k2), "a": np.arange(n), "w1": raw[:, 0], "w2": raw[:, 1]}
                )

    rows = texts.select("k1", "k2", "s").mapInArrow(windows, "k1 long, k2 long, a long, w1 long, w2 long")
    rows = rows.join(same.select("k1", "k2", "first"), ["k1", "k2"])
    counts = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("first", "a")).alias("low")).where("m > 1")
    hits = rows.join(counts, ["w1", "w2"])
    if keep == "first":
        hits = hits.where(F.struct("first", "a") != F.col("low"))
    return hits.groupBy("k1", "k2").agg(F.collect_list(F.array("a", "a")).alias("ranges"))


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.Table]:
    """Tables of complete anchor groups from batches sorted by anchor."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= rows:
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            first_of_last = int(np.flatnonzero(anchor == anchor[-1])[0])
            cut = min(first_of_last, int(np.searchsorted(anchor, anchor[min(rows, len(anchor)) - 1]))) or first_of_last
            if not cut:
                break
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that few texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _fits(df: DataFrame, entries: int) -> DataFrame:
    """Broadcast a narrow side of at most ``MAX_BROADCAST_ENTRIES`` entries; beyond that Spark shuffles."""
    return F.broadcast(df) if entries <= MAX_BROADCAST_ENTRIES else df


def _write(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long"), body.alias("t"), *[
        c.alias(n) for c, n in zip(_digest(body), ("h1", "h2"), strict=True)
    ])


def merged_runs(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of sorted [start, end) runs that overlap or touch."""
    out: list[list[int]] = []
    for x, y in runs:
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def left_over(t: bytes, runs: list[list[int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(t[at:a])
        at = b
    kept.append(t[at:])
    return b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (array of removed [start, end)), kept (bytes)."""
    if keep not in ("first", "none") or length < 2 * GRAM:
        raise ValueError(f"keep is 'first' or 'none', length at least {2 * GRAM}")
    base = prepared(docs, text)
    copies, runs = removed_runs(base, length, keep)
    entries = runs.agg(F.sum(2 + 2 * F.size("runs"))).first()[0] or 0
    rows = base.join(_fits(copies, 4 * copies.count()), ["h1", "h2"], "left").join(_fits(runs, entries), ["h1", "h2"], "left")
    is_copy = F.col("n").isNotNull()
    if keep == "first":
        is_copy = is_copy & ~F.col("doc_id").eqNullSafe(F.col("low"))
    whole = F.array(F.array(F.lit(0).cast("long"), F.octet_length("t").cast("long")))
    rows = rows.select("doc_id", "t", F.when(is_copy, whole).otherwise(F.col("runs")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            spans = [x or [] for x in batch.column("spans").to_pylist()]
            kept = [left_over(t.as_py(), x) if x else t.as_py() for t, x in zip(batch.column("t"), spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(batch.column("t")).cast(pa.int64()),
                 pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")


def repeat_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, and the digest of what is left (no copy stays)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return remove_repeats(docs, length, keep="none").select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def oracle_sql(length: int = 400) -> str:
    """``repeat_report`` in DuckDB SQL: every window's digest counted over the corpus."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * length})) AS m
      FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - {length - 1}, 0))) AS i FROM d)),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM hit),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
runs AS (SELECT r, run, min(i) AS a, max(i) + {length} AS b FROM numbered GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM runs
         UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (SELECT g.r, string_agg(substr(h, 2 * x + 1, CASE WHEN y IS NULL THEN len(h) ELSE 2 * (y - x) END), '' ORDER BY x) AS k
         FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r),
sums AS (SELECT r, sum(b - a) AS n, count(*) AS c FROM runs GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN sums ON sums.r = d.r
"""
