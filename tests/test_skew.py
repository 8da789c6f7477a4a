"""Hot keys: one user holds a third of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ratelake.operators import dashboard as D
from ratelake.operators import model as M
from ratelake.operators import stats as S
from ratelake.streaming import messages as SM

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _skewed(spark, n=3000):
    # user 0 holds every third row
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).cast("int").alias("userId"),
        (F.col("id") % 50).cast("int").alias("movieId"),
        ((F.col("id") * 7) % 13).cast("double").alias("prediction"),
        ((F.col("id") * 3) % 10 / 2 + 0.5).alias("rating"),
    )


def test_factor_join_splits_the_hot_user(spark, skew_conf):
    df = _skewed(spark)
    f = spark.range(100).select(
        F.col("id").cast("int").alias("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("features")
    )
    scored = M.score_factors(df, f, f)
    got = {r["event_id"]: r["prediction"] for r in scored.collect()}
    final = scored._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in final
    want = {r["event_id"]: float(r["userId"] * r["movieId"] + 1) for r in df.collect()}
    assert got == want


def test_aggregates_stay_exact_under_skew(spark, skew_conf):
    df = _skewed(spark)
    movies = spark.range(50).select(F.col("id").cast("int").alias("movieId"), F.lit("t").alias("title"), F.lit("G").alias("genres"))
    stats = {r["movieId"]: (r["num_ratings"], r["avg_rating"]) for r in S.item_stats(df, movies).collect()}
    plain = {
        r["movieId"]: (r["c"], r["a"])
        for r in df.groupBy("movieId").agg(F.count("rating").alias("c"), F.avg("rating").alias("a")).collect()
    }
    assert stats.keys() == plain.keys()
    assert all(stats[k][0] == plain[k][0] and abs(stats[k][1] - plain[k][1]) < 1e-12 for k in plain)
    top = D.user_top_all(df, 3).filter("userId = 0").orderBy("rank").collect()
    assert [r["prediction"] for r in top] == [12.0, 12.0, 12.0]


def test_best_rows_of_a_hot_user_are_limited_before_the_shuffle(spark):
    top = D.user_top_all(_skewed(spark), 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    pairs = D.user_top_all(_skewed(spark), 3, tie=("movieId", "event_id"))
    assert pairs.columns == ["userId", "rank", "event_id", "movieId", "prediction"] and pairs.count() == top.count()


def test_stream_scoring_splits_the_hot_user_of_large_factors(spark, skew_conf, tmp_path):
    _skewed(spark).select("event_id", "userId", "movieId").write.parquet(str(tmp_path / "src"))
    f = spark.range(100).select(
        F.col("id").cast("int").alias("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("features")
    )
    scorer = M.factor_scorer(f, f, max_broadcast_bytes=0)
    plans, rows = [], []

    def hook(batch, epoch):
        scored = scorer(batch)
        rows.extend(scored.collect())
        plans.append(scored._jdf.queryExecution().executedPlan().toString())

    stream = SM.message_stream(spark, fmt="parquet", schema="event_id long, userId int, movieId int", path=str(tmp_path / "src"))
    SM.run_available(SM.start_stream(stream, foreach_batch=hook, checkpoint=str(tmp_path / "ck"), trigger={"availableNow": True}))
    assert scorer.flags == {"broadcast_users": False, "broadcast_items": False}
    assert len(rows) == 3000 and all(r["prediction"] == r["userId"] * r["movieId"] + 1 for r in rows)
    assert any("skew=true" in p for p in plans)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    scorer.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() < before
