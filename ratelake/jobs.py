"""End-to-end jobs: the reference's three programs as DataFrame pipelines.

* ``prepare_ratings`` - profile the item and rating tables, join, enrich, write
  the enriched table partitioned by year, read it back.
* ``train_model`` - split, fit ALS, evaluate RMSE, save the model.
* ``start_scoring`` - message stream -> parse -> valid/rejected -> score ->
  Parquet prediction store (partitioned by date) and reject table, written
  epoch by epoch by one checkpointed query.
* ``dashboard`` - the dashboard queries over the prediction store.

Each returns DataFrames (or running queries); nothing is collected here
except the one-row results the caller asks for.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratelake import schemas
from ratelake.operators import dashboard as D
from ratelake.operators import enrich as E
from ratelake.operators import model as M
from ratelake.operators import quality as Q
from ratelake.operators import stats as S
from ratelake.session import scratch_path
from ratelake.sources import tables as TB
from ratelake.streaming import messages as SM
from ratelake.streaming import panels as P
from ratelake.streaming.store import PredictionStore

# The two ALS configurations used by the reference.
ALS_CONFIGS = {
    "A": dict(rank=10, max_iter=5, reg=0.01, cold_start="drop"),
    "B": dict(rank=10, max_iter=10, reg=0.1, num_item_blocks=10, nonnegative=True, cold_start="nan"),
}


# Training rows an ALS block may hold before more blocks are used than MLlib's 10.
ROWS_PER_BLOCK = 2_000_000

# Source columns that identify a message; those present are kept in the store.
MESSAGE_ID = ("topic", "partition", "offset")


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """Row count, missing values per column, duplicate summary and groups."""
    return {
        "rows": Q.row_count(df),
        "missing": Q.null_profile(df),
        "duplicates": Q.duplicate_summary(df),
        "duplicate_groups": Q.duplicate_groups(df),
    }


def prepare_ratings(
    spark: SparkSession,
    movies_path: str,
    ratings_path: str,
    out_path: str,
    csv: bool = True,
    lo: float = 0.5,
    hi: float = 5.0,
    staging: str | None = None,
) -> dict[str, DataFrame]:
    """Profile, clean, join, enrich, aggregate, write and verify.

    CSV inputs are parsed once with their fixed schemas and landed as Parquet
    under ``staging`` (default: a fresh folder in the shared checkpoint area).
    Every profile and statistic then scans the columnar copy, reading only the
    columns it needs, instead of re-parsing the text for each result; the
    written copy also cuts the lineage back to the raw files.

    Out-of-range ratings are removed *before* the join (the reference filtered
    after building the join, so its training data was never filtered).
    """
    if csv:
        staging = staging or scratch_path(spark, "staging")
        movies_pq, ratings_pq = os.path.join(staging, "movies"), os.path.join(staging, "ratings")
        TB.write_table(TB.read_csv(spark, movies_path, schemas.MOVIES), movies_pq)
        raw = TB.read_csv(spark, ratings_path, schemas.RATINGS, timestamp_format=schemas.CSV_TIMESTAMP_FORMAT)
        TB.write_table(raw, ratings_pq)
        movies_path, ratings_path = movies_pq, ratings_pq
    movies, ratings = TB.read_table(spark, movies_path), TB.read_table(spark, ratings_path)
    clean = Q.valid_ratings(ratings, lo, hi)
    enriched = E.build_enriched(movies, clean)
    TB.write_table(enriched, out_path, partition_by=["rating_year"], sort_within=["movieId"])
    stats = S.item_stats(clean, movies)
    out = {f"movies_{k}": v for k, v in profile(movies).items()}
    out.update({f"ratings_{k}": v for k, v in profile(ratings).items()})
    out.update(
        {
            "item_stats": stats,
            "top_rated": S.top_rated(stats),
            "catalogue": S.catalogue_summary(stats),
            "distribution": S.rating_distribution(clean, movies),
            "rating_stats": S.rating_stats(clean, movies),
            "yearly": S.yearly_stats(clean, movies),
            "genres": S.genre_stats(clean, movies),
            "written": TB.verify_table(spark, out_path),
        }
    )
    return out


def train_model(
    spark: SparkSession,
    enriched_path: str,
    model_path: str | None = None,
    config: str = "A",
    seed: int | None = 42,
    blocks: int | None = None,
) -> tuple[ALSModel, DataFrame]:
    """Fit one of the reference's ALS configurations; returns (model, one-row RMSE).

    The split is a deterministic hash of (user, item), so a retried task or a
    lost executor cannot move a rating between train and test. RMSE is taken
    over scored rows only (unscored rows are dropped under either cold-start
    setting).

    ``blocks`` sets both ALS block counts. By default there is one block per
    ``ROWS_PER_BLOCK`` training rows, and at least MLlib's 10, the named setting
    of both configurations (the block layout also seeds the initial factors, so
    results shift slightly with it).
    """
    data = TB.read_table(spark, enriched_path).select("userId", "movieId", "rating")
    key = F.xxhash64("userId", "movieId")
    train, test = M.key_split(data, key)
    cfg = dict(ALS_CONFIGS[config])
    wanted = blocks or max(10, -(-train.count() // ROWS_PER_BLOCK))
    if wanted != 10:
        cfg.update(num_user_blocks=wanted, num_item_blocks=wanted)
    model = M.train(train, seed=seed, **cfg)
    scored = M.drop_unscored(M.score(model, test))
    if model_path:
        TB.save_model(model, model_path)
    return model, M.rmse(scored)


class Scoring(list):
    """The started queries; ``release()`` drops the cached factor tables once they have ended."""

    def __init__(self, queries: list[StreamingQuery], release):
        super().__init__(queries)
        self.release = release


def start_scoring(
    spark: SparkSession,
    model_path: str,
    store_path: str,
    checkpoint: str,
    reject_path: str,
    source_format: str = "kafka",
    source_options: dict[str, str] | None = None,
    starting_offsets: str | None = "latest",
    min_partitions: int | None = None,
    trigger: dict | None = None,
    source_schema=None,
) -> Scoring:
    """Stream scoring into the prediction store, malformed messages to a reject table.

    One query reads every message once and writes it to exactly one of the two
    tables; a replayed micro-batch overwrites its own ``epoch`` folders. The
    store keeps the source's topic, partition and offset where it has them.
    For Kafka, ``maxOffsetsPerTrigger`` in ``source_options`` bounds each
    micro-batch, and ``min_partitions`` spreads a topic with few partitions
    over more tasks.
    """
    model = TB.load_model(model_path)
    scorer = M.factor_scorer(model.userFactors, model.itemFactors, cold_start=model.getColdStartStrategy())
    raw = SM.message_stream(
        spark, source_format, source_options, starting_offsets, schema=source_schema,
        min_partitions=min_partitions,
    )
    ids = [c for c in MESSAGE_ID if c in raw.columns]
    # the raw text rides along so that rejected rows keep what could not be parsed
    parsed = SM.parse_messages(raw.withColumn("value", F.col("value").cast("string")), keep=("value", *ids))

    def to_store(valid: DataFrame) -> DataFrame:
        scored = SM.score_stream(valid.drop("value"), scorer)
        columns = ["userId", "movieId", F.col("prediction").cast("float").alias("prediction"), "timestamp", *ids]
        return scored.select(*columns).withColumn("event_date", F.to_date("timestamp"))

    hook = SM.epoch_writer(store_path, reject_path, to_store, panels=True)
    query = SM.start_stream(
        parsed, foreach_batch=hook, checkpoint=checkpoint, trigger=trigger or {"processingTime": "2 seconds"}
    )
    return Scoring([query], scorer.release)


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    """The prediction store, folded or not; a store that holds no row yet is an empty table."""
    return PredictionStore(spark, store_path).read()


def _panels_of_cells(store: PredictionStore, p: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    cells, scores = store.cells(), p.schema["prediction"].dataType
    window = store.window_cells(as_of, cells=cells)
    trends = P.trends(window)
    return {
        "stats": P.stats(cells),
        "distribution": P.distribution(cells).withColumn("prediction", F.col("prediction").cast(scores)),
        "top_items": P.top_items(cells),
        "activity": trends.select("hour", "n_predictions"),
        "trends": trends,
        "summary": P.summary(cells, window),
    }


def _panels_of_rows(p: DataFrame, as_of: dt.datetime | None, ts: str, date_col: str) -> dict[str, DataFrame]:
    return {
        "stats": D.dash_stats(p),
        "distribution": D.dash_distribution(p),
        "top_items": D.dash_top_items(p),
        "activity": D.dash_activity(p, as_of, ts=ts, date_col=date_col),
        "trends": D.dash_trends(p, as_of, ts=ts, date_col=date_col),
        "summary": D.dash_summary(p, as_of, ts=ts),
    }


def dashboard(
    spark: SparkSession,
    store_path: str,
    as_of: dt.datetime | str | None = None,
    ts: str = "timestamp",
    tie=None,
    date_col: str = "event_date",
    item_id: int | None = None,
    user_id: int | None = None,
    k: int = 5,
) -> dict[str, DataFrame]:
    """The dashboard's queries over the prediction store written by ``start_scoring``.

    ``as_of`` ends the 24-hour window: the current UTC time by default (as the
    reference does), a given time, or ``"latest"`` for the newest stored row.
    ``item_id`` adds that item's statistics, ``user_id`` that user's best ``k``
    predictions and the length of the list. Ties go to the message's topic,
    partition and offset where the store has them. The latest rows are looked for in the
    newest dates first; item and user lookups skip row groups where the store is folded. The other
    panels come from the store's partial aggregates, unless another time column is asked for.
    """
    store = PredictionStore(spark, store_path)
    p = store.read()
    if as_of is None:
        as_of = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    elif as_of == "latest":
        as_of = store.newest() if ts == "timestamp" else D.resolve_as_of(p, ts, date_col)
    if tie is None:
        tie = ("movieId", "userId", *(c for c in MESSAGE_ID if c in p.columns))
    panels = _panels_of_cells(store, p, as_of) if ts == "timestamp" and as_of is not None else _panels_of_rows(p, as_of, ts, date_col)
    out = {**panels, "recent": store.latest(10, ts=ts, tie=tie), "summary_recent": store.latest(5, ts=ts, tie=tie)}
    if item_id is not None:
        out["item"] = D.dash_item_stats(p, item_id)
    if user_id is not None:
        out["user_top"] = D.user_top(p, user_id, k, tie=tie)
        out["user_top_size"] = D.user_top_size(p, user_id, k)
    return out
