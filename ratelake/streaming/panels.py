"""Partial aggregates of the prediction store, so that a dashboard refresh does not scan it.

``partials`` turns rows into mergeable cells, one table for four kinds of them:

=====  ==========================  ===========================================================
kind   key                         holds
=====  ==========================  ===========================================================
item   ``id`` (movieId)            rows, scored rows, sum of predictions
value  ``value`` (prediction)      rows
user   ``hour``, ``id`` (userId)   rows: the exact way to count distinct users
hour   ``hour``                    rows, scored rows, sum of predictions, sketch of the users
=====  ==========================  ===========================================================

Every figure is a sum or a mergeable sketch, so cells of several micro-batches merge by
``merged`` in any order and ``partials`` of a union equals ``merged`` of the partials. A null prediction is a
row but not a scored one; a NaN prediction makes sums NaN, as an average over the rows would
be; rows without a time have a null hour. The panels below equal those of
``operators.dashboard`` over the rows: the window of the last hours starts inside an hour, whose rows
are read from the store itself (``edge_rows``), all later hours come from cells.

Cells number at most the rows they come from. ``item`` and ``hour`` cells are far fewer; ``user`` cells are the
users active in each hour and ``value`` cells the distinct predictions, which for
unrounded model output may be nearly as many as rows (of 12 bytes each).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import hour_of_day, missing
from ratelake.operators import dashboard as D

KIND = "kind"
KEYS = ("kind", "hour", "id", "value")
SCHEMA = "hour timestamp, id bigint, value double, n bigint, scored bigint, total double, users binary, kind string"
SKETCH_BITS = 12  # 4,096 registers: a relative standard error of about 1.6 %


def partials(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The cells of ``rows`` (columns userId, movieId, prediction and ``ts``)."""
    p = rows.select(
        F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour"),
        F.col("userId").cast("bigint").alias("user"),
        F.col("movieId").cast("bigint").alias("item"),
        F.col("prediction").cast("double").alias("value"),
    )
    sums = (F.count(F.lit(1)).alias("n"), F.count("value").alias("scored"), F.sum("value").alias("total"))
    hours = p.groupBy("hour").agg(*sums, F.hll_sketch_agg("user", F.lit(SKETCH_BITS)).alias("users"))
    # The other three kinds in one grouping: a row meets its three keys, tasks combine them before the shuffle.
    key = lambda kind, **of: F.struct(
        F.lit(kind).alias(KIND), *[of.get(c, F.lit(None).cast(t)).alias(c) for c, t in (("hour", "timestamp"), ("id", "bigint"), ("value", "double"))]
    )
    keys = F.array(
        key("item", id=F.col("item")),
        key("user", hour=F.col("hour"), id=F.col("user")),
        F.when(~missing("value"), key("value", value=F.col("value"))),
    )
    met = p.select(F.col("value").alias("score"), F.explode(F.array_compact(keys)).alias("key"))
    of_item = F.col("key.kind") == "item"
    plain = met.groupBy(*[F.col(f"key.{c}").alias(c) for c in KEYS]).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(of_item, F.col("score"))).alias("scored"), F.sum(F.when(of_item, F.col("score"))).alias("total")
    )
    return _conform(hours.withColumn(KIND, F.lit("hour"))).unionAll(_conform(plain))


def _conform(cells: DataFrame) -> DataFrame:
    fields = [f.strip().split(" ") for f in SCHEMA.split(",")]
    return cells.select(*[(F.col(c) if c in cells.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def merged(cells: DataFrame) -> DataFrame:
    """One cell a key. Sketches live in ``hour`` cells only, so the other kinds merge by plain hash aggregation."""
    sums = [F.sum(c).alias(c) for c in ("n", "scored", "total")]
    plain = cells.filter(F.col(KIND) != "hour").groupBy(*KEYS).agg(*sums)
    hours = cells.filter(F.col(KIND) == "hour").groupBy(*KEYS).agg(*sums, F.hll_union_agg("users").alias("users"))
    return _conform(plain).unionAll(_conform(hours))


def write(cells: DataFrame, path: str, files: int | None = None) -> None:
    """Write cells by kind; in files of even size, or ordered into about ``files`` files, so that a window skips row groups."""
    out = cells.hint("rebalance", KIND) if files is None else cells.repartitionByRange(max(1, files), *KEYS).sortWithinPartitions(*KEYS)
    out.write.mode("overwrite").partitionBy(KIND).parquet(path)


# --------------------------------------------------------------------------- panels over cells


def _of(cells: DataFrame, kind: str) -> DataFrame:
    return cells.filter(F.col(KIND) == kind)


def _mean() -> Column:
    return F.try_divide(F.sum("total"), F.sum("scored"))  # null without a scored row


def _users(kind: str, approx: bool, among: Column | None = None) -> Column:
    """Distinct users of the cells ``among``: from ``user`` cells, or from the sketches of ``hour`` cells."""
    here = F.col(KIND) == kind if among is None else (F.col(KIND) == kind) & among
    if approx:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(here, F.col("users")))), F.lit(0))
    return F.count_distinct(F.when(here, F.col("id")))


def _totals(among: Column) -> tuple[Column, Column]:
    count = F.coalesce(F.sum(F.when(among, F.col("n"))), F.lit(0))
    return count, F.try_divide(F.sum(F.when(among, F.col("total"))), F.sum(F.when(among, F.col("scored"))))


def stats(cells: DataFrame, approx_users: bool = False) -> DataFrame:
    """``total_predictions, avg_prediction`` (2 digits), ``unique_users``, in one aggregate over ``hour`` and ``user`` cells."""
    kind = "hour" if approx_users else "user"
    n, mean = _totals(F.col(KIND) == "hour")
    return cells.filter(F.col(KIND).isin("hour", kind)).agg(
        n.alias("total_predictions"), F.round(mean, 2).alias("avg_prediction"), _users(kind, approx_users).alias("unique_users")
    )


def top_items(cells: DataFrame, min_count: int = 5, k: int = 10) -> DataFrame:
    """Top ``k`` items by mean prediction with at least ``min_count`` rows; null and NaN means last."""
    return (
        _of(cells, "item")
        .groupBy(F.col("id").alias("movieId"))
        .agg(_mean().alias("average_rating"), F.sum("n").alias("total_ratings"))
        .filter(F.col("total_ratings") >= min_count)
        .orderBy(D._desc_score("average_rating"), F.col("movieId").asc())
        .limit(k)
    )


def distribution(cells: DataFrame) -> DataFrame:
    """``prediction, n_predictions`` for every exact value, ascending; null and NaN are no value."""
    values = _of(cells, "value").groupBy(F.col("value").alias("prediction")).agg(F.sum("n").alias("n_predictions"))
    return values.orderBy("prediction")


def window_edge(as_of: dt.datetime, hours: int = 24) -> tuple[dt.datetime, dt.datetime]:
    """(start of the window, the first full hour in it), as wall-clock times."""
    start = D._window_start(as_of, hours)
    full = start.replace(minute=0, second=0, microsecond=0)
    return start, full if full == start else full + dt.timedelta(hours=1)


def in_window(cells: DataFrame, edge_rows: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Cells of the last ``hours`` hours: full hours as stored, the first one from its rows."""
    start, full = window_edge(as_of, hours)
    whole = cells.filter(F.col(KIND).isin("hour", "user") & (F.col("hour") >= D._wall_clock(full)))
    return whole.unionByName(_conform(partials(edge_rows)).filter(F.col(KIND).isin("hour", "user")))


def trends(window: DataFrame) -> DataFrame:
    """``hour, avg_rating, n_predictions`` by hour of day of a window's cells."""
    hours = _of(window, "hour").groupBy(hour_of_day("hour").alias("hour"))
    return hours.agg(_mean().alias("avg_rating"), F.sum("n").alias("n_predictions")).orderBy("hour")


def summary(cells: DataFrame, window: DataFrame | None, approx_users: bool = False) -> DataFrame:
    """``total_predictions, active_users_24h, avg_rating``; without a window (an empty store) no user is active."""
    kind = "hour" if approx_users else "user"
    both = _of(cells, "hour").withColumn("recent", F.lit(False))
    if window is not None:
        both = both.unionByName(_of(window, kind).withColumn("recent", F.lit(True)))
    n, mean = _totals(~F.col("recent"))
    return both.agg(n.alias("total_predictions"), _users(kind, approx_users, F.col("recent")).alias("active_users_24h"), mean.alias("avg_rating"))
