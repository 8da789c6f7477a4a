"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become lower-case runs of letters and digits. A seed is a fixed mask over a
short token window; the tokens under its zeros are ignored, so a hit survives
substitutions there. Training and benchmark windows meet by seed hash (only windows
whose outer tokens occur so in the benchmark are hashed); every hit gives an
alignment (item, offset). Around it the item's tokens are compared with
the document's, and the pair counts as an overlap if some ``window`` consecutive
aligned tokens hold at most ``substitutions`` differences.

Only hits leave the scan: no text is shuffled unless the documents with hits are
too many to broadcast. Benchmark hashes are broadcast while their counted rows stay
within the bound of ``small_side``; otherwise the join shuffles.

Defined results: null and empty texts, and items of fewer tokens than ``window`` or
than the longest seed, never overlap; equal rows give one row per item; repeated
items each count; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.llm.common import saved, small_side, with_plain_names

SEEDS = ("110101101", "101100111", "111001011")
WINDOW = 13
SUBSTITUTIONS = 2
MAX_LITERALS = 50_000  # hashes of window ends that are written into the plan


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits; an empty array for none."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    # The only empty pieces are those before the first and after the last run.
    return F.array_remove(F.transform(runs, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _ends(seeds: tuple[str, ...]) -> list[int]:
    """The first and the last position that all seeds look at."""
    if len({len(s) for s in seeds}) != 1 or any(s[0] != "1" for s in seeds):
        raise ValueError("seeds have one length and look at their first token")
    return sorted({0, max(k for k in range(len(seeds[0])) if all(s[k] == "1" for s in seeds))})


def _windows(df: DataFrame, seeds: tuple[str, ...], key: str, ends: list[int] | None = None) -> DataFrame:
    """(key, pos, seed) of all windows; ``df`` has a column ``h`` of token hashes.

    ``ends`` are the hashes that the tokens at the seeds' common ends may have:
    no other window can meet a seed of theirs, so its seeds are not computed.
    """
    h = F.col("h")
    look = lambda i, k: F.get(h, i + F.lit(k))
    starts = F.when(F.size(h) >= len(seeds[0]), F.sequence(F.lit(0), F.size(h) - len(seeds[0])))
    if ends is not None:
        starts = F.filter(starts, lambda i: F.xxhash64(*[look(i, k) for k in _ends(seeds)]).isin(ends))
    found = F.transform(
        starts,
        lambda i: F.array(
            *[
                F.struct(i.alias("pos"), F.xxhash64(F.lit(n), *[look(i, k) for k, c in enumerate(s) if c == "1"]).alias("seed"))
                for n, s in enumerate(seeds)
            ]
        ),
    )
    return df.select(key, F.explode(F.flatten(found)).alias("w")).select(key, "w.pos", "w.seed")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    seeds: tuple[str, ...] = SEEDS,
    window: int = WINDOW,
    substitutions: int = SUBSTITUTIONS,
) -> DataFrame:
    """(key, doc_id, item_id, pos, n_tokens, n_equal): the best alignment of every overlapping pair.

    ``key`` identifies the row's doc_id and text; ``pos`` is the document token that
    the item's first token falls on (it may be negative for a partial passage).
    """
    hashed = token_hashes(F.col("text"))
    least = max(window, len(seeds[0]))
    items = saved(
        benchmark.select("item_id", hashed.alias("h"))
        .where(F.size("h") >= least)
        .select(F.col("item_id"), F.xxhash64("item_id", "h").alias("item"), "h")
        .distinct()
    )
    known = saved(_windows(items, seeds, "item").withColumnRenamed("pos", "item_pos"))
    pairs_of = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.size("h") - len(seeds[0])), lambda i: F.xxhash64(*[F.get("h", i + F.lit(k)) for k in _ends(seeds)])
        )
    )
    ends = saved(items.select(pairs_of.alias("e")).distinct())
    few = ends.count() <= MAX_LITERALS  # a benchmark beyond that is met by its seeds alone
    literals = sorted(r["e"] for r in ends.collect()) if few else None
    key = F.xxhash64("doc_id", "text").alias("key")
    scan = docs.where(F.col("text").isNotNull())
    found = _windows(scan.select(key, hashed.alias("h")), seeds, "key", literals)
    hits = found.join(small_side(known, known.count()), "seed").select(
        "key", F.struct("item", (F.col("pos") - F.col("item_pos")).alias("shift")).alias("hit")
    )
    wanted = saved(hits.groupBy("key").agg(F.collect_set("hit").alias("hits")))
    near = scan.select("doc_id", "text", key).join(small_side(wanted, wanted.count()), "key")
    pairs = (
        near.select("key", "doc_id", hashed.alias("d"), F.explode("hits").alias("hit"))
        .select("key", "doc_id", "d", "hit.item", "hit.shift")
        .join(small_side(items, items.count()), "item")
    )
    place = lambda i: i + F.col("shift")
    same = F.transform(
        "h", lambda x, i: F.when((place(i) >= 0) & (F.get("d", F.greatest(place(i), F.lit(0))) == x), 1).otherwise(0)
    )
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.size("same") - (window - 1)),
            lambda i: F.aggregate(F.slice("same", i, window), F.lit(0), lambda n, x: n + x),
        )
    )
    checked = pairs.select("key", "doc_id", "item_id", "shift", same.alias("same")).withColumn("best", best)
    equal = F.aggregate("same", F.lit(0), lambda n, x: n + x)
    return (
        checked.where(F.col("best") >= window - substitutions)
        .groupBy("key", "doc_id", "item_id")
        .agg(F.max(F.struct(equal.alias("e"), (-F.col("shift")).alias("s"), F.size("same").alias("n"))).alias("m"))
        .select(
            "key",
            "doc_id",
            "item_id",
            (-F.col("m.s")).cast("long").alias("pos"),
            F.col("m.n").cast("long").alias("n_tokens"),
            F.col("m.e").cast("long").alias("n_equal"),
        )
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    return overlaps(docs, benchmark).drop("key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item."""
    hit = saved(overlaps(docs.select("doc_id", "text"), benchmark).select(F.col("key").alias("__key")).distinct())
    side = small_side(hit, hit.count())
    return with_plain_names(docs, lambda rows: rows.join(side, F.xxhash64("doc_id", "text") == F.col("__key"), "left_anti"))


def oracle_sql() -> str:
    """The same overlaps in DuckDB SQL, by tokens instead of hashes."""
    seeds = " UNION ALL ".join(
        f"SELECT k, {n} AS seed, i, [{', '.join(f't[i + {k}]' for k, c in enumerate(s, 1) if c == '1')}] AS v "
        f"FROM (SELECT k, t, unnest(range(0, len(t) - {len(s) - 1})) AS i FROM SRC)"
        for n, s in enumerate(SEEDS)
    )
    toks = (
        "[w FOR w IN string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') "
        "IF w <> '']"
    )
    least = max(WINDOW, max(map(len, SEEDS)))
    return f"""
WITH d AS (SELECT doc_id AS k, {toks} AS t FROM documents),
b AS (SELECT * FROM (SELECT item_id AS k, {toks} AS t FROM benchmark) WHERE len(t) >= {least}),
ds AS ({seeds.replace("SRC", "d")}),
bs AS ({seeds.replace("SRC", "b")}),
hits AS (SELECT DISTINCT ds.k AS doc_id, bs.k AS item_id, ds.i - bs.i AS shift
         FROM ds JOIN bs ON ds.seed = bs.seed AND ds.v = bs.v),
same AS (SELECT doc_id, item_id, shift,
                [CASE WHEN j + shift >= 0 AND d.t[j + shift + 1] = b.t[j + 1] THEN 1 ELSE 0 END
                 FOR j IN range(0, len(b.t))] AS s
         FROM hits JOIN d ON d.k = doc_id JOIN b ON b.k = item_id),
ok AS (SELECT * FROM same
       WHERE list_max([list_sum(s[j : j + {WINDOW - 1}]) FOR j IN range(1, len(s) - {WINDOW - 2})]) >= {WINDOW - SUBSTITUTIONS})
SELECT doc_id, item_id, CAST(shift AS BIGINT) AS pos, CAST(len(s) AS BIGINT) AS n_tokens,
       CAST(list_sum(s) AS BIGINT) AS n_equal
FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY list_sum(s) DESC, shift) = 1
"""
