"""Physical-plan properties of the registered batch queries."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

# Queries that execute while being built (streams, round trips, model fits).
EAGER = {
    "csv_roundtrip",
    "parquet_roundtrip",
    "als_train_score",
    "als_cold_start",
    "stream_parse",
    "stream_score_sink",
    "store_trends_24h",
    "csv_inferred",
    "movies_csv_roundtrip",
    "stream_decode",
    "stream_rejects",
    "stream_two_queries",
}
BATCH = [n for n in E.QUERIES if n not in EAGER]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")


def _plan(spark, name: str) -> str:
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_in_the_plan(spark, name):
    plan = _plan(spark, name)
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert marker not in plan, f"{name} runs Python: {marker}"


def test_rolling_window_bound_reaches_the_scan(spark):
    plan = _plan(spark, "dash_activity_24h")
    assert "GreaterThanOrEqual(ts," in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "top_rated")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "l_extendedprice" not in plan and "o_orderdate" not in plan


def test_item_stats_aggregates_before_the_item_join(spark):
    df = E.queries()["item_stats"](spark, SF_SMALL)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    # The join's rating side is an Aggregate (one row per item), not raw ratings.
    join_at = optimized.index("Join Inner")
    assert "Aggregate [movieId" in optimized[join_at:]


def test_top_k_is_take_ordered(spark):
    for name in ("top_rated", "dash_top_items", "dash_latest_10", "dash_user_top"):
        assert "TakeOrderedAndProject" in _plan(spark, name), name
