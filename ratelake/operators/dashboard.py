"""Dashboard queries over the prediction table.

The reference answered these from a document store (aggregation pipelines and
a pandas value count in the web process). Here each is a Spark query over the
Parquet prediction table written by the scoring stream. Columns used:
``userId, movieId, prediction`` and a timestamp column (``ts`` by default),
plus an id column used to break ties (``event_id`` by default).

Rolling-window queries take ``as_of`` as a literal: a literal bound is pushed
into the Parquet scan (row-group skipping, and partition pruning when the
table is partitioned by date), which a scalar-subquery bound is not.
``resolve_as_of`` finds ``max(ts)`` with one small aggregate when the caller
has no clock value to pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelake.functions.columns import hour_of_day, missing, nan_to_null

TS = "ts"
TIE = "event_id"


def resolve_as_of(p: DataFrame, ts: str = TS, date_col: str | None = None) -> dt.datetime | None:
    """``max(ts)`` of the table: one column scanned, one row returned.

    With ``date_col`` (a date partition column) the newest date is found first
    and ``max(ts)`` is then read from that partition only. The time is the
    table's wall clock (UTC for a zoned column), whatever zone the driver's
    machine is in.
    """
    if date_col:
        newest = p.agg(F.max(date_col).alias("d")).first()["d"]
        if newest is None:
            return None
        p = p.filter(F.col(date_col) == F.lit(newest))
    return p.agg(F.max(ts).cast("timestamp_ntz").alias("m")).first()["m"]


def _window_start(as_of: dt.datetime, hours: int) -> dt.datetime:
    """Wall-clock start of the window; a zoned ``as_of`` is taken to UTC first."""
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return as_of - dt.timedelta(hours=hours)


def _wall_clock(t: dt.datetime):
    # Through text: a datetime literal would be read in the zone of the driver's machine.
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def last_hours(p: DataFrame, as_of, hours: int = 24, ts: str = TS, date_col: str | None = None) -> DataFrame:
    """Rows with ``ts >= as_of - hours``; none if ``as_of`` is None (an empty table).

    ``date_col`` names a date partition column of the table (the prediction
    store is partitioned by ``event_date``); the same bound on it prunes whole
    directories before any file is opened.
    """
    if as_of is None:
        return p.filter(F.lit(False))
    start = _window_start(as_of, hours)
    out = p.filter(F.col(ts) >= _wall_clock(start))
    if date_col:
        out = out.filter(F.col(date_col) >= F.lit(start.date().isoformat()).cast("date"))
    return out


def _ties(tie, descending: bool):
    cols = [tie] if isinstance(tie, str) else list(tie)
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def dash_stats(p: DataFrame, approx_users: bool = False) -> DataFrame:
    """``total_predictions, avg_prediction`` (2 digits), ``unique_users``.

    The distinct-user count is a two-phase aggregate (de-duplicate per task,
    shuffle distinct ids) instead of a set shipped to one place;
    ``approx_users=True`` swaps in a mergeable HyperLogLog++ sketch.
    """
    users = F.approx_count_distinct("userId") if approx_users else F.count_distinct("userId")
    return p.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.round(F.avg("prediction"), 2).alias("avg_prediction"),
        users.alias("unique_users"),
    )


def dash_item_stats(p: DataFrame, item_id: int) -> DataFrame:
    """Mean, count, max, min of one item's predictions; no row if it is unknown."""
    return (
        p.filter(F.col("movieId") == F.lit(item_id))
        .agg(
            F.avg("prediction").alias("avg_rating"),
            F.count(F.lit(1)).alias("count_ratings"),
            F.max("prediction").alias("max_rating"),
            F.min("prediction").alias("min_rating"),
        )
        .filter(F.col("count_ratings") > 0)
        .select(F.lit(item_id).cast("bigint").alias("movieId"), "*")
    )


def dash_top_items(p: DataFrame, min_count: int = 5, k: int = 10) -> DataFrame:
    """Top ``k`` items by mean prediction with at least ``min_count`` rows.

    Partial aggregation per task, one shuffle on the item id, then a
    TakeOrderedAndProject (no global sort). A NaN or null mean ranks last, as
    the reference's store sorted NaN below every number.
    """
    return (
        p.groupBy("movieId")
        .agg(F.avg("prediction").alias("average_rating"), F.count(F.lit(1)).alias("total_ratings"))
        .filter(F.col("total_ratings") >= min_count)
        .orderBy(_desc_score("average_rating"), F.col("movieId").asc())
        .limit(k)
    )


def dash_activity(p: DataFrame, as_of, hours: int = 24, ts: str = TS, date_col: str | None = None) -> DataFrame:
    """``hour, n_predictions`` by hour of day over the last ``hours`` hours.

    As in the reference, the two partial ends of the same clock hour fall into
    one group.
    """
    return (
        last_hours(p, as_of, hours, ts, date_col)
        .groupBy(hour_of_day(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n_predictions"))
        .orderBy("hour")
    )


def dash_trends(p: DataFrame, as_of, hours: int = 24, ts: str = TS, date_col: str | None = None) -> DataFrame:
    """``hour, avg_rating, n_predictions`` by hour of day over the last ``hours`` hours."""
    return (
        last_hours(p, as_of, hours, ts, date_col)
        .groupBy(hour_of_day(ts).alias("hour"))
        .agg(F.avg("prediction").alias("avg_rating"), F.count(F.lit(1)).alias("n_predictions"))
        .orderBy("hour")
    )


def dash_summary(p: DataFrame, as_of, hours: int = 24, ts: str = TS, approx_users: bool = False) -> DataFrame:
    """``total_predictions, active_users_24h, avg_rating`` in one pass.

    The reference issued four store queries; the active-user count is a
    conditional distinct count inside the same aggregate (``approx_users``:
    a HyperLogLog++ sketch instead). An empty table gives 0 and a null mean
    instead of an error. The latest rows are ``latest``.
    """
    in_window = F.lit(False) if as_of is None else F.col(ts) >= _wall_clock(_window_start(as_of, hours))
    recent_user = F.when(in_window, F.col("userId"))
    active = F.approx_count_distinct(recent_user) if approx_users else F.count_distinct(recent_user)
    return p.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        active.alias("active_users_24h"),
        F.avg("prediction").alias("avg_rating"),
    )


def latest(p: DataFrame, k: int = 10, ts: str = TS, tie: str = TIE, columns=None) -> DataFrame:
    """The ``k`` most recent rows (ties broken by the id, newest id first)."""
    out = p.orderBy(F.col(ts).desc(), *_ties(tie, True)).limit(k)
    return out.select(*columns) if columns else out


def dash_distribution(p: DataFrame) -> DataFrame:
    """``prediction, n_predictions`` for every exact value, ascending; null/NaN dropped."""
    return (
        p.filter(~missing("prediction"))
        .groupBy("prediction")
        .agg(F.count(F.lit(1)).alias("n_predictions"))
        .orderBy("prediction")
    )


def _desc_score(col: str = "prediction"):
    # Missing scores rank last (NaN would otherwise sort above every number).
    return nan_to_null(col).desc_nulls_last()


def user_top(p: DataFrame, user_id: int, k: int = 5, tie=TIE) -> DataFrame:
    """One user's ``k`` best predictions: ``movieId, prediction`` (after a single tie column)."""
    return (
        p.filter(F.col("userId") == F.lit(user_id))
        .orderBy(_desc_score(), *_ties(tie, False))
        .limit(k)
        .select(*([tie] if isinstance(tie, str) else []), "movieId", "prediction")
    )


def user_top_size(p: DataFrame, user_id: int, k: int = 5) -> DataFrame:
    """One row ``userId, n_items``: the length of the user's list, at most ``k``."""
    mine = p.filter(F.col("userId") == F.lit(user_id)).limit(k)
    return mine.agg(F.count(F.lit(1)).alias("n_items")).select(F.lit(user_id).cast("bigint").alias("userId"), "n_items")


def user_top_all(p: DataFrame, k: int = 5, tie=TIE) -> DataFrame:
    """Every user's ``k`` best predictions, with ``rank``.

    The ``rank <= k`` filter reaches the window: each task keeps its own best
    ``k`` rows of a user before the shuffle (``WindowGroupLimit``), so a user
    that holds a third of the table sends at most ``k`` rows per task.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    order = Window.partitionBy("userId").orderBy(_desc_score(), *_ties(tie, False))
    ranked = p.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.select("userId", "rank", *[t for t in ties if t not in ("userId", "movieId")], "movieId", "prediction")
