"""Stream checks: the fixtures' events replayed as JSON rating messages.

A file stream over the events table stands in for the message broker (the
Kafka connector jar is not on this classpath); the parse and score stages are
the library's, and the sink is the checkpointed Parquet prediction store.
Each run uses fresh output and checkpoint folders in the shared scratch area.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators import dashboard as D
from ratelake.operators import model as M
from ratelake.operators import versions as V
from ratelake.plans import fixtures as FX
from ratelake.session import parallelism, remove_scratch, scratch_path
from ratelake.sources import files as FS
from ratelake.streaming import log as LG
from ratelake.streaming import messages as SM
from ratelake.streaming import progress as PR
from ratelake.streaming.store import PredictionStore


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, in tasks of a bounded number of rows (counted from Parquet footers).

    The glob names the table itself, be it one file or a folder of files.
    """
    table = FX.table(spark, d, "events")
    return SM.message_stream(
        spark,
        fmt="parquet",
        schema=table.schema,
        path=os.path.join(d, "events.parque[t]"),
        min_partitions=max(parallelism(spark), -(-table.count() // SM.TASK_ROWS)),
    )


def _event_messages(spark: SparkSession, d: str) -> DataFrame:
    """Streaming ``value`` column: one JSON message per event row."""
    preds = _events(spark, d).select(
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("int").alias("movieId"),
        F.col("value").alias("prediction"),
        "ts",
    )
    return FX.messages_of(preds)


def _drain(df: DataFrame, spark: SparkSession, label: str, partition_by=None) -> str:
    out = scratch_path(spark, f"{label}-out")
    ckpt = scratch_path(spark, f"{label}-ckpt")
    q = SM.start_stream(
        df,
        sink="parquet",
        path=out,
        checkpoint=ckpt,
        trigger={"availableNow": True},
        partition_by=partition_by,
    )
    SM.run_available(q)
    remove_scratch(spark, ckpt)  # a drained one-off query is never resumed
    return out


def _wall_clock(df: DataFrame) -> DataFrame:
    # Message times parse as zoned timestamps; the source table's are zone-less.
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def q_stream_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = SM.parse_messages(_event_messages(spark, d))
    out = _drain(parsed, spark, "parse")
    return _wall_clock(spark.read.parquet(out))


def _score_into_store(spark: SparkSession, d: str) -> tuple[str, str]:
    """Messages -> parse -> (scored store by date, rejects), written epoch by epoch by one query."""
    return _score_messages(spark, d, _event_messages(spark, d))


def _score_messages(spark: SparkSession, d: str, messages: DataFrame) -> tuple[str, str]:
    f = FX.factors(spark, d)
    scorer = M.factor_scorer(f, f, cold_start="nan")
    store, rejects, ckpt = (scratch_path(spark, label) for label in ("store", "rejects", "score-ckpt"))

    def to_store(valid: DataFrame) -> DataFrame:
        return SM.score_stream(valid.drop("value"), scorer).withColumn("event_date", F.to_date("timestamp"))

    parsed = SM.parse_messages(messages, keep=("value",))
    hook = SM.epoch_writer(store, rejects, to_store)
    try:
        SM.run_available(SM.start_stream(parsed, foreach_batch=hook, checkpoint=ckpt, trigger={"availableNow": True}))
    finally:
        scorer.release()
    remove_scratch(spark, ckpt)
    return store, rejects


def q_stream_score_sink(spark: SparkSession, d: str) -> DataFrame:
    store, _ = _score_into_store(spark, d)
    back = spark.read.parquet(store).drop("epoch")
    return _wall_clock(back).withColumn("prediction", F.round("prediction", 6))


def q_store_trends_24h(spark: SparkSession, d: str) -> DataFrame:
    """The hourly trend panel read from the stream-written store.

    The newest date folder gives the end of the window; the 24-hour bound is
    applied to the timestamp and to the ``event_date`` partition column, so only
    the last two date folders are read.
    """
    store = spark.read.parquet(_score_into_store(spark, d)[0])
    as_of = D.resolve_as_of(store, "timestamp", date_col="event_date")
    trends = D.dash_trends(store, as_of, ts="timestamp", date_col="event_date")
    return trends.withColumn("avg_rating", F.round("avg_rating", 6))


def q_stream_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Of every ten messages one is no JSON, one has too wide an id and one lacks an id.

    ``stored`` counts what the same query put into the store, so a message lost
    between the two tables would show.
    """
    events = _events(spark, d)
    user, item = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 10
    value = (
        F.when(kind == 0, F.concat(F.lit("not json "), F.col("event_id").cast("string")))
        .when(kind == 1, F.concat(F.lit('{"userId": '), (F.col("user_id") + 3_000_000_000).cast("string"), F.lit(', "movieId": '), item, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"userId": '), user, F.lit("}")))
        .otherwise(F.concat(F.lit('{"userId": '), user, F.lit(', "movieId": '), item, F.lit("}")))
    )
    store, rejects = _score_messages(spark, d, events.select(value.alias("value")))
    stored = spark.read.parquet(store).agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.lit("stored"))
    back = spark.read.parquet(rejects).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return back.unionByName(stored)


def q_stream_decode(spark: SparkSession, d: str) -> DataFrame:
    """Binary keys and values, as a message broker delivers them, decoded to text."""
    raw = _events(spark, d).select(
        F.col("event_id").cast("string").cast("binary").alias("key"),
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).cast("binary").alias("value"),
    )
    return spark.read.parquet(_drain(SM.decode_messages(raw), spark, "decode"))


def q_stream_two_queries(spark: SparkSession, d: str) -> DataFrame:
    """Two queries over one stream, each with its own checkpoint: raw messages and parsed rows."""
    messages = _event_messages(spark, d)
    places = {name: (scratch_path(spark, f"two-{name}"), scratch_path(spark, f"two-{name}-ckpt")) for name in ("raw", "parsed")}
    frames = {"raw": messages, "parsed": SM.parse_messages(messages)}
    started = SM.start_many(
        (frames[name], dict(sink="parquet", path=out, checkpoint=ckpt, trigger={"availableNow": True}))
        for name, (out, ckpt) in places.items()
    )
    for query in started:
        SM.run_available(query)
    remove_scratch(spark, *(ckpt for _, ckpt in places.values()))
    raw, parsed = (spark.read.parquet(places[name][0]) for name in ("raw", "parsed"))
    counted = raw.agg(F.lit("raw").alias("query"), F.count("value").alias("n_rows"), F.lit(None).cast("bigint").alias("sum_user"))
    return counted.unionByName(
        parsed.agg(F.lit("parsed").alias("query"), F.count(F.lit(1)).alias("n_rows"), F.sum("userId").cast("bigint").alias("sum_user"))
    )


# --------------------------------------------------------------------------- the stored message log and the managed store


def _logged_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a keyed JSON message, with a 0 or 1 (``half``) that deals the events over two appends."""
    preds = FX.predictions(spark, d)
    columns = ["userId", "movieId", "prediction", "ts"]
    halves = [
        FX.messages_of(preds.where(F.col("event_id") % 2 == half).select(*columns)).withColumn("half", F.lit(half)) for half in (0, 1)
    ]
    return halves[0].unionAll(halves[1]).withColumn("key", F.get_json_object("value", "$.userId"))


def _log_stream(spark: SparkSession, path: str, start: str, **options: str) -> DataFrame:
    return SM.message_stream(spark, fmt=LG.register(spark), options={"path": path, **options}, starting_offsets=start)


def _drained(query) -> None:
    """Run a timed query until the log holds nothing new, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _positions_query(spark: SparkSession, d: str, start: str) -> DataFrame:
    """Half of the messages lie in the log before a stream starts, the other half comes while it runs."""
    messages, path = _logged_messages(spark, d), scratch_path(spark, f"log-{start}")
    out, ckpt = scratch_path(spark, f"{start}-out"), scratch_path(spark, f"{start}-ckpt")
    LG.append_messages(messages.where("half = 0"), path)
    parsed = SM.parse_messages(_log_stream(spark, path, start))
    query = SM.start_stream(parsed, path=out, checkpoint=ckpt, trigger={"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()  # the starting position is taken
        LG.append_messages(messages.where("half = 1"), path)
        query.processAllAvailable()
    finally:
        query.stop()
    remove_scratch(spark, path, ckpt)
    return _wall_clock(spark.read.parquet(out))


def q_stream_earliest(spark: SparkSession, d: str) -> DataFrame:
    """A stream from the earliest offset reads the backlog and what comes after."""
    return _positions_query(spark, d, "earliest")


def q_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """A stream from the latest offset skips the backlog."""
    return _positions_query(spark, d, "latest")


EPOCHS = 8
_FOLDED: dict[tuple[str, str], PredictionStore] = {}


def folded_store(spark: SparkSession, d: str) -> PredictionStore:
    """The events scored into a store by micro-batches of an eighth of them, folded half way and at the end.

    The stream stops after the first half, the closed epochs are folded, and it goes on from its
    checkpoint with the rest; the last micro-batch stays open, with its partial aggregates. The queries over such a store share one in a session.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDED or not FS.exists(spark, _FOLDED[key].path):
        _FOLDED[key] = _folded_store(spark, d)
    return _FOLDED[key]


def _folded_store(spark: SparkSession, d: str) -> PredictionStore:
    messages = _logged_messages(spark, d)
    path, ckpt, place, rejects = (scratch_path(spark, n) for n in ("log", "fold-ckpt", "fold-store", "fold-rejects"))
    most = max(1, -(-messages.count() // EPOCHS))
    f = FX.factors(spark, d)
    scorer = M.factor_scorer(f, f, cold_start="nan")

    def to_store(valid: DataFrame) -> DataFrame:
        return SM.score_stream(valid.drop("value"), scorer).withColumn("event_date", F.to_date("timestamp"))

    store = PredictionStore(spark, place)
    try:
        for half in (0, 1):
            LG.append_messages(messages.where(F.col("half") == half), path)
            stream = _log_stream(spark, path, "earliest", maxOffsetsPerTrigger=str(most), group="fold")
            parsed = SM.parse_messages(stream, keep=("value",))
            hook = SM.epoch_writer(place, rejects, to_store, panels=True)
            _drained(SM.start_stream(parsed, foreach_batch=hook, checkpoint=ckpt, trigger={"processingTime": "0 seconds"}))
            store.compact(fan_in=2 + half)
    finally:
        scorer.release()
    store.vacuum(grace_seconds=0)
    remove_scratch(spark, path, ckpt)
    return store


def q_store_folded(spark: SparkSession, d: str) -> DataFrame:
    """The whole store after folding: every message once."""
    return _wall_clock(folded_store(spark, d).read()).withColumn("prediction", F.round("prediction", 6))


def q_store_latest_10(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest predictions, looked for in the newest dates first."""
    rows = folded_store(spark, d).latest(10, columns=["userId", "movieId", "prediction", "timestamp"])
    return _wall_clock(rows).withColumn("prediction", F.round("prediction", 6))


def q_store_item_stats(spark: SparkSession, d: str, item_id: int = 42) -> DataFrame:
    """One item's statistics by a pruned lookup in the clustered store."""
    out = folded_store(spark, d).item_stats(item_id)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_rating", "max_rating", "min_rating")})


def q_store_user_top(spark: SparkSession, d: str, user_id: int = 7) -> DataFrame:
    """One user's five best predictions by a pruned lookup in the clustered store."""
    out = folded_store(spark, d).user_top(user_id, tie=("movieId",))
    return out.withColumn("prediction", F.round("prediction", 6))


def q_panel_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals and distinct users merged from partial aggregates."""
    return folded_store(spark, d).panel_stats()


def q_panel_top_items(spark: SparkSession, d: str) -> DataFrame:
    """The ten best items merged from partial aggregates."""
    return folded_store(spark, d).panel_top_items().withColumn("average_rating", F.round("average_rating", 6))


def q_panel_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every exact prediction, merged from partial aggregates and shown to 6 digits."""
    shown = folded_store(spark, d).panel_distribution().groupBy(F.round("prediction", 6).alias("prediction"))
    return shown.agg(F.sum("n_predictions").alias("n_predictions"))


def q_panel_trends_24h(spark: SparkSession, d: str) -> DataFrame:
    """The hourly trend of the last 24 hours: full hours from partial aggregates, the first one from its rows."""
    store = folded_store(spark, d)
    as_of = store.newest()
    trends = store.panel_trends(as_of) if as_of is not None else D.dash_trends(store.read(), None, ts="timestamp")
    return trends.withColumn("avg_rating", F.round("avg_rating", 6))


def q_panel_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals and the users of the last 24 hours, from partial aggregates and the window's first hour of rows."""
    store = folded_store(spark, d)
    return store.panel_summary(store.newest()).withColumn("avg_rating", F.round("avg_rating", 6))


def q_stream_timed(spark: SparkSession, d: str) -> DataFrame:
    """All messages through bounded micro-batches two seconds apart.

    The listener's records must show several micro-batches, none over its bound, no two in one
    two-second slot, and every message once.
    """
    messages, path = _logged_messages(spark, d), scratch_path(spark, "timed-log")
    out, ckpt = scratch_path(spark, "timed-out"), scratch_path(spark, "timed-ckpt")
    LG.append_messages(messages, path)
    n = messages.count()
    most = max(1, -(-n // 3))
    log = PR.watch(spark, interval_ms=2000)
    try:
        parsed = SM.parse_messages(_log_stream(spark, path, "earliest", maxOffsetsPerTrigger=str(most), group="timed"))
        query = SM.start_stream(parsed, path=out, checkpoint=ckpt, trigger={"processingTime": "2 seconds"})
        _drained(query)
        log.wait_ended(query)
    finally:
        PR.unwatch(spark, log)
    records, seen = log.of(query), log.summary(query)
    slots = [int(r["started"].timestamp() * 1000) // 2000 for r in records]
    on_time = all(a < b for a, b in zip(slots, slots[1:], strict=False))
    if n and (seen["batches"] < min(n, 3) or seen["input_rows"] != n or max(r["input_rows"] for r in records) > most or not on_time):
        raise RuntimeError(f"micro-batches are not as configured: {seen}")
    remove_scratch(spark, path, ckpt)
    return _wall_clock(spark.read.parquet(out))


def q_stream_console(spark: SparkSession, d: str) -> DataFrame:
    """The parsed messages on the console (a row of each micro-batch is shown), and how many each micro-batch brought."""
    messages, path = _logged_messages(spark, d), scratch_path(spark, "console-log")
    LG.append_messages(messages, path)
    log = PR.watch(spark)
    try:
        parsed = SM.parse_messages(_log_stream(spark, path, "earliest"))
        query = SM.start_stream(parsed, sink="console", trigger={"processingTime": "0 seconds"}, options={"numRows": "1"})
        query.processAllAvailable()
        LG.append_messages(messages.where("half = 1"), path)
        _drained(query)
        log.wait_ended(query)
    finally:
        PR.unwatch(spark, log)
    remove_scratch(spark, path)
    return log.as_table(spark, query).select("batch_id", "input_rows")


def q_stream_two_models(spark: SparkSession, d: str) -> DataFrame:
    """One running stream, two model versions: the second is published between two appends and has twice the item factors."""
    messages, f = _logged_messages(spark, d), FX.factors(spark, d)
    path, root, place, rejects, ckpt = (scratch_path(spark, n) for n in ("models-log", "models", "models-store", "models-rejects", "models-ckpt"))
    scorer = V.CurrentScorer(spark, root)

    def to_store(valid: DataFrame) -> DataFrame:
        return SM.score_stream(valid.drop("value"), scorer).withColumn("event_date", F.to_date("timestamp"))

    V.publish_factors(f, f, root)
    LG.append_messages(messages.where("half = 0"), path)
    parsed = SM.parse_messages(_log_stream(spark, path, "earliest"), keep=("value",))
    query = SM.start_stream(parsed, foreach_batch=SM.epoch_writer(place, rejects, to_store), checkpoint=ckpt, trigger={"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        V.publish_factors(f, f.withColumn("features", F.transform("features", lambda x: x * 2)), root)
        LG.append_messages(messages.where("half = 1"), path)
        query.processAllAvailable()
    finally:
        query.stop()
        scorer.release()
    remove_scratch(spark, path, root, ckpt)
    back = PredictionStore(spark, place).read().select("userId", "movieId", "timestamp", "prediction", "model_version")
    return _wall_clock(back).withColumn("prediction", F.round("prediction", 6))
