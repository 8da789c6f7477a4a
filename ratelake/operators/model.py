"""Collaborative-filtering model: split, train, score, evaluate.

Training is MLlib ALS (block-partitioned alternating least squares). Scoring
has two forms that give the same numbers: ``score`` (``ALSModel.transform``)
and ``score_factors``, the same two left joins and a dot product written as
DataFrame operations over any pair of id -> vector tables.
"""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import dot, missing
from ratelake.session import ensure_checkpoint_dir


def random_split(df: DataFrame, train_fraction: float = 0.8, seed: int | None = None):
    """Random (train, test) split, as the reference does it.

    Reproducible for a seed only while the input partitioning stays the same.
    """
    weights = [train_fraction, 1.0 - train_fraction]
    return tuple(df.randomSplit(weights, seed) if seed is not None else df.randomSplit(weights))


def key_split(df: DataFrame, key, buckets: int = 10, train_buckets: int = 8):
    """Deterministic (train, test) split on a key expression: ``pmod(key, buckets) < train_buckets``.

    Independent of partitioning and task retries, and repeatable in SQL.
    """
    bucket = F.pmod(key, F.lit(buckets))
    return df.filter(bucket < train_buckets), df.filter(bucket >= train_buckets)


def split_sizes(df: DataFrame, key, buckets: int = 10, train_buckets: int = 8) -> DataFrame:
    """``part, n_rows`` for a key split, from one scan."""
    part = F.when(F.pmod(key, F.lit(buckets)) < train_buckets, F.lit("train")).otherwise(F.lit("test"))
    return df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))


def train(
    df: DataFrame,
    rank: int = 10,
    max_iter: int = 5,
    reg: float = 0.01,
    user_col: str = "userId",
    item_col: str = "movieId",
    rating_col: str = "rating",
    cold_start: str = "drop",
    nonnegative: bool = False,
    num_user_blocks: int | None = None,
    num_item_blocks: int | None = None,
    seed: int | None = None,
    checkpoint_interval: int = 10,
) -> ALSModel:
    """Fit explicit-feedback ALS.

    Config A of the reference: rank 10, 5 iterations, reg 0.01, cold start
    ``drop``. Config B: rank 10, 10 iterations, reg 0.1, 10 item blocks,
    non-negative, cold start ``nan``. Long runs cut the RDD lineage every
    ``checkpoint_interval`` iterations into the shared checkpoint folder.
    Rows with a null id or rating, or an id above int, are left out first (ALS
    rejects them); ``unusable_rows`` counts them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    clean = df.select(
        F.col(user_col).try_cast("int").alias(user_col),
        F.col(item_col).try_cast("int").alias(item_col),
        F.col(rating_col).try_cast("float").alias(rating_col),
    ).dropna()
    als = ALS(
        rank=rank,
        maxIter=max_iter,
        regParam=reg,
        userCol=user_col,
        itemCol=item_col,
        ratingCol=rating_col,
        coldStartStrategy=cold_start,
        nonnegative=nonnegative,
        checkpointInterval=checkpoint_interval,
    )
    if num_user_blocks:
        als = als.setNumUserBlocks(num_user_blocks)
    if num_item_blocks:
        als = als.setNumItemBlocks(num_item_blocks)
    if seed is not None:
        als = als.setSeed(seed)
    return als.fit(clean)


def unusable_rows(df: DataFrame, user_col: str = "userId", item_col: str = "movieId", rating_col: str = "rating") -> DataFrame:
    """One row ``n_rows, n_unusable``: the rows that ``train`` leaves out."""
    usable = (
        F.col(user_col).try_cast("int").isNotNull()
        & F.col(item_col).try_cast("int").isNotNull()
        & F.col(rating_col).try_cast("float").isNotNull()
    )
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~usable).alias("n_unusable"))


def score(model: ALSModel, df: DataFrame) -> DataFrame:
    """Append ``prediction`` with the model (works on batch and streaming frames)."""
    return model.transform(df)


def score_factors(
    df: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    user_col: str = "userId",
    item_col: str = "movieId",
    cold_start: str = "nan",
    out_col: str = "prediction",
    broadcast_users: bool = False,
    broadcast_items: bool = False,
) -> DataFrame:
    """``df`` + dot(user vector, item vector), the ALS scoring plan as joins.

    Two left equi-joins on the ids. By default no broadcast hint: factor
    tables grow with the number of users and items; Catalyst/AQE broadcast
    them only when their measured size is under the threshold, else shuffle
    both sides on the id. ``factor_scorer`` sets the ``broadcast_*`` flags
    after measuring the tables. ``cold_start="nan"`` keeps unknown ids with a
    null score, ``"drop"`` removes them.
    """
    u = user_factors.select(F.col("id").alias("_uid"), F.col("features").alias("_uf"))
    i = item_factors.select(F.col("id").alias("_iid"), F.col("features").alias("_if"))
    u = F.broadcast(u) if broadcast_users else u
    i = F.broadcast(i) if broadcast_items else i
    how = "inner" if cold_start == "drop" else "left"
    scored = df.join(u, df[user_col] == u["_uid"], how).join(i, F.col(item_col) == i["_iid"], how)
    return scored.withColumn(out_col, dot("_uf", "_if")).drop("_uid", "_uf", "_iid", "_if")


# Bytes per factor row besides the vector's floats (id, array header, row overhead).
FACTOR_ROW_OVERHEAD = 48


def factor_bytes(factors: DataFrame) -> int:
    """In-memory size bound of an ``id, features`` table, from one aggregate pass."""
    per_row = F.size("features").cast("long") * 4 + FACTOR_ROW_OVERHEAD
    return factors.agg(F.sum(per_row).alias("b")).first()["b"] or 0


# A batch job builds its broadcasts once, so their bound is larger than a stream's.
BATCH_BROADCAST_BYTES = 64 << 20


def score_measured(
    df: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    cold_start: str = "nan",
    max_broadcast_bytes: int = BATCH_BROADCAST_BYTES,
) -> DataFrame:
    """``score_factors`` of a batch table, each factor table measured and broadcast if it is within the bound.

    Then the rows are scored where they are; otherwise they are shuffled on both ids, on the
    second one with the first one's vectors.
    """
    own = factor_bytes(user_factors)
    sizes = own, own if item_factors is user_factors else factor_bytes(item_factors)
    users, items = (n <= max_broadcast_bytes for n in sizes)
    return score_factors(df, user_factors, item_factors, cold_start=cold_start, broadcast_users=users, broadcast_items=items)


def factor_scorer(
    user_factors: DataFrame,
    item_factors: DataFrame,
    max_broadcast_bytes: int = 8 << 20,
    cold_start: str = "nan",
    user_col: str = "userId",
    item_col: str = "movieId",
):
    """A scoring function for streams, with broadcasts decided up front.

    Each factor table is measured once (``factor_bytes``: a bound computed from
    the rows, not an estimate) and cached. A table of at most
    ``max_broadcast_bytes`` is broadcast from the cache. A larger one is joined by
    a shuffle of both sides in every micro-batch, which adaptive execution can
    split where one user or item holds a large share of the messages.

    The bound is small on purpose: a stream rebuilds its broadcasts in every
    micro-batch and ships them to every executor. Call ``release()`` when the
    query has ended to drop the cached tables.
    """

    def place(f: DataFrame) -> tuple[DataFrame, bool]:
        kept = f.persist()
        return kept, factor_bytes(kept) <= max_broadcast_bytes

    user_factors, bu = place(user_factors)
    item_factors, bi = place(item_factors)
    flags = {"broadcast_users": bu, "broadcast_items": bi}

    def scorer(df: DataFrame) -> DataFrame:
        return score_factors(
            df, user_factors, item_factors, user_col=user_col, item_col=item_col, cold_start=cold_start, **flags
        )

    def release() -> None:
        user_factors.unpersist()
        item_factors.unpersist()

    scorer.flags = flags
    scorer.release = release
    return scorer


def model_factors(model: ALSModel) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors) as ``id, features`` tables."""
    return model.userFactors, model.itemFactors


def rmse(df: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """One row ``rmse``: sqrt(mean((label - prediction)^2)); NaN in -> NaN out."""
    err = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def rmse_value(df: DataFrame, label: str = "rating", prediction: str = "prediction") -> float:
    """The MLlib evaluator's RMSE, as the reference computes it."""
    return RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol=prediction).evaluate(df)


def count_unscored(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row ``n_unscored``: predictions that are null or NaN."""
    return df.agg(F.count_if(missing(prediction)).alias("n_unscored"))


def drop_unscored(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Remove rows without a usable prediction (null or NaN)."""
    return df.na.drop(subset=[prediction])
