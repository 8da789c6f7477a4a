"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets weight q proportional to ``p ** alpha``. Alpha
is bisected (many probes per pass, each pass one small aggregation) until the
weights meet a target entropy or until no source is repeated more than
``max_repeats`` times. The budget is the smallest one in which every source is
read whole at least once, so no document is lost. A source's budget is realised
as passes over its hash permutation, each pass starting at another place; the
token position inside the budget gives the block, and a block's rows are permuted
by hash. Every block holds each source in proportion to its weight.

Defined results: tokens are white-space separated words, at least 1 for every
row (also null and empty texts); a null source is a source of its own; an empty
table gives an empty result; repeated rows are separate rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.llm.common import saved, small_side, top_bits, with_plain_names, without

BUCKET_BITS = 10  # a source is ranked in 2**BUCKET_BITS pieces
BLOCK_TOKENS = 1 << 19
PROBES = 16


def token_count(text: Column) -> Column:
    return F.greatest(F.coalesce(F.size(F.split(F.trim(text), r"\s+")), F.lit(1)), F.lit(1)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key: a null source never meets a real one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def bisect_alpha(
    totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, passes: int = 6
) -> float:
    """The largest exponent in [0, 1] whose weights reach ``target_entropy`` (nats) or, if that is not
    given, the smallest whose largest repetition is at most ``max_repeats``. ``totals``: __src, __n."""
    shares = totals.select(F.log("__n").alias("ln"))
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        probes = [lo + (hi - lo) * i / PROBES for i in range(PROBES + 1)]
        # log-sum-exp around the largest share keeps the powers in range
        top = shares.select(F.max("ln").alias("top")).first()["top"]
        grid = shares.select("ln", F.explode(F.array(*[F.lit(p) for p in probes])).alias("a"))
        w = F.exp(F.col("a") * (F.col("ln") - F.lit(top)))
        got = (
            grid.groupBy("a")
            .agg(
                F.sum(w).alias("z"),
                F.sum(w * F.col("a") * (F.col("ln") - F.lit(top))).alias("s"),
                (F.max((F.col("a") - 1) * F.col("ln")) - F.min((F.col("a") - 1) * F.col("ln"))).alias("spread"),
            )
            .collect()  # one row per probe
        )
        ok = {}
        for r in got:
            if target_entropy is not None:
                ok[r["a"]] = math.log(r["z"]) - r["s"] / r["z"] >= target_entropy - 1e-12
            else:
                ok[r["a"]] = r["spread"] <= math.log(max_repeats) + 1e-12
        if target_entropy is not None:  # entropy falls with alpha: keep the last probe that reaches it
            good = [p for p in probes if ok[p]]
            lo = max(good) if good else probes[0]
            hi = min([p for p in probes if p > lo], default=lo)
        else:  # repetition falls with alpha: keep the first probe within the limit
            hi = min(p for p in probes if ok[p])
            lo = max([p for p in probes if p < hi], default=hi)
        if hi <= lo:
            break
    return lo if target_entropy is not None else hi


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = 1.5,
    block_tokens: int = BLOCK_TOKENS,
    tokens: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with one row per read: __src, __tokens, __epoch, __block, __key (order in the block), __weight."""
    if target_entropy is None and (max_repeats is None or max_repeats < 1):
        raise ValueError("give a target entropy, or a repetition limit of at least 1")
    spark = docs.sparkSession
    # Rows of one id differ by text; equal rows are told apart by nothing and need not be.
    base = docs.withColumns(
        {
            "__src": source_key(F.col("source")),
            "__tokens": token_count(F.col("text")) if tokens is None else tokens,
            "__h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
        }
    ).withColumn("__bucket", top_bits(F.col("__h"), BUCKET_BITS))
    cells = saved(
        base.groupBy("__src", "__bucket").agg(F.sum("__tokens").alias("__cell"))
    )  # sources x 2**BUCKET_BITS rows at most
    totals = saved(cells.groupBy("__src").agg(F.sum("__cell").alias("__n")))
    n_sources = totals.count()
    if not n_sources:
        empty = {"__epoch": "int", "__block": "long", "__key": "long", "__weight": "double"}
        return base.drop("__h", "__bucket").withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    alpha = bisect_alpha(totals, target_entropy, max_repeats)
    norm = totals.agg(
        F.sum(F.pow("__n", F.lit(alpha))).alias("z"),
        F.max(F.col("__n") / F.pow("__n", F.lit(alpha))).alias("m"),
    ).first()
    budget = norm["z"] * norm["m"]  # every source whole at least once
    blocks = max(1, math.ceil(budget / block_tokens))
    weights = totals.select(
        "__src",
        F.col("__n").cast("double").alias("__n"),
        (F.pow("__n", F.lit(alpha)) / F.lit(norm["z"])).alias("__weight"),
    ).withColumn("__budget", F.col("__weight") * F.lit(budget))
    before = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = cells.withColumn("__before", F.coalesce(F.sum("__cell").over(before), F.lit(0))).drop("__cell")
    plan = saved(prefix.join(weights, "__src"))
    # One row per source and bucket: broadcast when counted small, else the join shares the window's shuffle.
    inside = Window.partitionBy("__src", "__bucket").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(small_side(plan, n_sources << BUCKET_BITS), ["__src", "__bucket"]).withColumn(
        "__at", F.col("__before") + F.coalesce(F.sum("__tokens").over(inside), F.lit(0))
    )
    # Pass e starts a golden-ratio step further along the permutation and wraps round.
    passes = F.ceil(F.col("__budget") / F.col("__n") - F.lit(1e-9)).cast("int")
    reads = placed.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
    turned = F.pmod(F.col("__at") + F.floor(F.col("__n") * F.pmod(F.col("__epoch") * F.lit(0.6180339887498949), F.lit(1.0))), F.col("__n"))
    reads = reads.withColumn("__pos", F.col("__epoch") * F.col("__n") + turned).where(
        (F.col("__epoch") == 0) | (F.col("__pos") < F.col("__budget"))
    )
    block = F.least(F.floor(F.col("__pos") / F.col("__budget") * F.lit(blocks)), F.lit(blocks - 1)).cast("long")
    return reads.withColumns(
        {"__block": block, "__key": F.xxhash64(F.lit(seed + 1), F.col("__h"), F.col("__epoch"))}
    ).drop("__h", "__bucket", "__before", "__at", "__pos", "__n", "__budget")


def mixture(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 1.5) -> DataFrame:
    """One row per read of a document: doc_id, source, epoch, block, slot in the block, tokens, weight."""
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("text"), token_count(F.col("text")).alias("__tokens"))
    reads = mix(slim, target_entropy, max_repeats, tokens=F.col("__tokens"))
    order = Window.partitionBy("__block").orderBy("__key", "doc_id", "__epoch")  # a block's tokens are bounded
    return reads.select(
        "doc_id",
        "source",
        F.col("__epoch").alias("epoch"),
        F.col("__block").alias("block"),
        (F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.col("__tokens").alias("tokens"),
        F.col("__weight").alias("weight"),
    )


def mixed_documents(docs: DataFrame, max_repeats: float = 1.5) -> DataFrame:
    """The columns of ``docs``, one row per read, laid out in block order."""

    def run(rows: DataFrame) -> DataFrame:
        reads = mix(rows, max_repeats=max_repeats)
        ordered = reads.repartitionByRange("__block", "__key").sortWithinPartitions("__block", "__key")
        return without(ordered, "__src", "__tokens", "__epoch", "__block", "__key", "__weight").select(*rows.columns)

    return with_plain_names(docs, run)
