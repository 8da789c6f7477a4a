"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own codebook of K
centroids, which gives K * K cells. For a query the cells are visited in order
of summed half distances (a heap over centroid pairs) until they hold
``visit_share`` of all distinct vectors; the entries of those cells are reranked
by the exact cosine. Vectors without structure (all far apart) need a large
share; copies of one vector count once, so they can't use up a query's visits.

Index: every row is indexed; only the two codebooks are fitted on a bounded
sample (``sample`` rows with the smallest id hash). A slab is the cells that share
a first centroid. Slabs and the queries that probe them are cut into blocks of
bounded size, so a cell that holds a third of all rows is searched by many tasks.
Only the codebooks and one count per cell (K * K) reach the driver.

Defined results: a vector that is null, empty or zero, holds a null or
non-finite component, or has another length than the most common one takes no
part, neither as query nor as candidate; null ids neither; ties go to the
smaller id; rows that share the query's id are never its neighbours; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelake.llm.common import saved

CENTROIDS = 128  # of each half
BLOCK = 1024  # vectors, or queries, compared at once


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists("v", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == F.lit(common["n"] if common else 0))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every centre."""
    d = (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0)


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres (distinct points spread by squared distance, then Lloyd rounds)."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = [points[rng.integers(len(points))]]
    best = gaps(points, np.array(centres))[:, 0]
    while len(centres) < k and best.sum() > 0:
        centres.append(points[rng.choice(len(points), p=best / best.sum())])
        best = np.minimum(best, gaps(points, centres[-1][None, :])[:, 0])
    c = np.array(centres)
    for _ in range(rounds):
        near = gaps(points, c).argmin(axis=1)
        for i in range(len(c)):
            own = points[near == i]
            if len(own):
                c[i] = own.mean(axis=0)
    return c


def fit(vectors: DataFrame, centroids: int = CENTROIDS, sample: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Two codebooks from the ``sample`` rows of smallest id hash."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    m = unit(np.array([r["v"] for r in got], np.float64))
    half = (m.shape[1] + 1) // 2
    first = kmeans(m[:, :half], centroids)
    second = kmeans(m[:, half:], centroids) if m.shape[1] > half else np.zeros((1, 0))
    return first, second


def visit_order(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, visit: float) -> list[tuple[int, int]]:
    """Non-empty centroid pairs by summed distance until they hold ``visit`` (or none is left)."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    held_by = counts.tolist()
    heap = [(s1[0] + s2[0], 0, 0)]  # one entry for each row of the pair table reached so far
    out, held = [], 0
    while heap and held < visit:
        _, i, j = heap[0]
        if j + 1 < len(s2):
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        n = held_by[o1[i]][o2[j]]
        if n:
            out.append((o1[i], o2[j]))
            held += n
    return out


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, largest component in [0.5, 1): squares neither overflow nor vanish, cosines stay."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def best_pairs(
    qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, seen: np.ndarray, code: np.ndarray, k: int
) -> pd.DataFrame:
    """The ``k`` nearest rows by exact cosine of every query, among the cells it visits (``seen[query, code]``).

    Equal vectors beyond the k + 1 smallest ids can't be among them.
    """
    order = np.lexsort((vid, *v.T[::-1]))
    vid, v, code = vid[order], v[order], code[order]
    fresh = np.r_[True, (v[1:] != v[:-1]).any(axis=1)]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), 0))
    # A repeated id can fill places only if it isn't the query's own, so count distinct ids.
    new_id = np.cumsum(fresh | np.r_[True, vid[1:] != vid[:-1]])
    keep = new_id - new_id[start] <= k
    vid, v, code = vid[keep], v[keep], code[keep]
    near = unit(q) @ unit(v).T
    near[(qid[:, None] == vid[None, :]) | ~seen[:, code]] = -np.inf
    kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
    i, j = np.nonzero((near >= kth[:, None] - 1e-9) & np.isfinite(near))
    q, v = scaled(q), scaled(v)
    dot, nq, nv = np.zeros(len(i)), np.zeros(len(q)), np.zeros(len(v))
    for c in range(q.shape[1]):  # component by component: equal vectors get equal scores
        dot += q[i, c] * v[j, c]
        nq += q[:, c] * q[:, c]
        nv += v[:, c] * v[:, c]
    out = pd.DataFrame({"query_id": qid[i], "vec_id": vid[j], "score": dot / (np.sqrt(nq)[i] * np.sqrt(nv)[j])})
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return out.groupby("query_id", sort=False).head(k)


def search(
    table: DataFrame, every: int = 50, k: int = 5, visit_share: float = 0.35, centroids: int = CENTROIDS,
    sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    vectors = valid_vectors(table, id_col, vec_col)
    if vectors.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first, second = fit(vectors, centroids, sample)
    half, width = first.shape[1], len(second)

    def halves(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m = unit(np.stack(f["v"].to_numpy()).astype(np.float64))
        return gaps(m[:, :half], first), gaps(m[:, half:], second)

    def codes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d1, d2 = halves(f)
            yield f.assign(slab=d1.argmin(1), code=d2.argmin(1))

    index = saved(vectors.mapInPandas(codes_of, "vec_id long, v array<double>, slab int, code int"))
    distinct = index.groupBy("slab", "code", F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros((len(first), width), np.int64)
    for r in distinct.groupBy("slab", "code").count().collect():  # at most K * K
        counts[r["slab"], r["code"]] = r["count"]
    # At least k distinct vectors besides the query's own, however small the table.
    visit = max(visit_share * counts.sum(), k + 1)

    def probes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d1, d2 = halves(f)
            for r in range(len(f)):
                found: dict[int, list[int]] = {}
                for i, j in visit_order(d1[r], d2[r], counts, visit):
                    found.setdefault(i, []).append(j)
                yield pd.DataFrame(
                    {"vec_id": f["vec_id"].iloc[r], "v": [f["v"].iloc[r]] * len(found), "slab": list(found), "codes": list(found.values())}
                )

    # Repeated rows of one id ask once, with one of its vectors.
    queries = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    probes = saved(queries.mapInPandas(probes_of, "vec_id long, v array<double>, slab int, codes array<int>"))
    asked = probes.groupBy("slab").agg(F.count(F.lit(1)).alias("asked"))
    plan = index.groupBy("slab").agg(F.count(F.lit(1)).alias("held")).join(asked, "slab")
    plan = F.broadcast(  # at most K rows
        plan.select("slab", F.ceil(F.col("held") / BLOCK).cast("int").alias("vb"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("qb"))
    )
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(plan, "slab").select("slab", place("vb").alias("x"), spread("qb").alias("y"), "vec_id", "v", "code")
    wanted = probes.join(plan, "slab").select("slab", spread("vb").alias("x"), place("qb").alias("y"), "vec_id", "v", "codes")

    def rerank(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        seen = np.zeros((len(q), width), bool)
        for r, codes in enumerate(q["codes"]):
            seen[r, codes] = True
        qm, vm = (np.stack(f["v"].to_numpy()).astype(np.float64) for f in (q, v))
        return best_pairs(q["vec_id"].to_numpy(), qm, v["vec_id"].to_numpy(), vm, seen, v["code"].to_numpy(), k)

    near = (
        wanted.groupBy("slab", "x", "y")
        .cogroup(held.groupBy("slab", "x", "y"))
        .applyInPandas(rerank, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
