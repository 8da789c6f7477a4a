"""Duplicates by digest equal duplicates by whole rows, and move fewer bytes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ratelake.operators import digests as G
from ratelake.operators import quality as Q

NAN = float("nan")
ROWS = [
    (1, "a", 0.0, [1], "x"),
    (1, "a", -0.0, [1], "x"),  # equal to the first
    (1, None, 0.0, [1], "x"),
    (None, "a", 0.0, [1], "x"),
    (None, None, None, None, None),
    (None, None, None, None, None),
    (2, "b", NAN, [1, None], "y"),
    (2, "b", NAN, [1, None], "y"),
    (2, "b", NAN, [1], "y"),
    (3, "", 1.0, [], ""),
    (3, "x" * 100_000, 1.0, [], ""),
    (3, "x" * 100_000, 1.0, [], ""),
    (3, "x" * 100_000, 1.0, [], ""),
]
SCHEMA = "`a.b` int, digest string, score double, list array<int>, copies string"


def _plain(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("bound", [G.MAX_BROADCAST, 0])
@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_digests_equal_whole_rows(spark, rows, bound):
    df = spark.createDataFrame(rows, SCHEMA)
    for columns in (None, ["a.b"], ["digest", "score"]):
        assert _plain(G.duplicate_summary(df, columns, bound)) == _plain(Q.duplicate_summary(df, columns))
        assert _plain(G.duplicate_groups(df, columns, bound)) == _plain(Q.duplicate_groups(df, columns))
    once, want = G.dedup(df, bound), Q.dedup(df)
    assert once.schema == df.schema
    assert _plain(once.withColumn("score", F.col("score") + 0.0)) == _plain(want.withColumn("score", F.col("score") + 0.0))


def test_rows_that_share_a_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(G, "digest", lambda columns: F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")))
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert _plain(G.duplicate_summary(df)) == _plain(Q.duplicate_summary(df))
    assert G.dedup(df).count() == Q.dedup(df).count()


def test_unique_rows_are_not_shuffled(spark):
    body = F.concat_ws(" ", *[F.sha2((F.col("id") * 7 + k).cast("string"), 256) for k in range(8)])
    df = spark.range(2000).select((F.col("id") % 1990).alias("id")).withColumn("body", body)
    plan = G.dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    groups = G.duplicate_groups(df, ["id", "body"])
    assert {r["n_copies"] for r in groups.collect()} == {2} and groups.count() == 10
    assert G.duplicate_summary(df).first().asDict() == {"total_rows": 2000, "unique_rows": 1990, "duplicate_rows": 10}
