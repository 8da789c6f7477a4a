from __future__ import annotations

import datetime as dt
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ratelake.operators import dashboard as D
from tests.conftest import ROOT, SF_SMALL

SCHEMA = "event_id long, userId int, movieId int, prediction double, ts timestamp"
NOW = dt.datetime(2024, 1, 30, 12, 0, 0)


def _p(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(spark):
    h = dt.timedelta(hours=1)
    return _p(
        spark,
        [
            (1, 7, 10, 4.5, NOW - 30 * h),  # outside the 24 h window
            (2, 7, 11, 3.0, NOW - 2 * h),
            (3, 7, 12, float("nan"), NOW - 1 * h),
            (4, 7, 13, None, NOW),
            (5, 7, 14, 3.0, NOW - 3 * h),
            (6, 8, 10, 2.0, NOW - 23 * h),
            (7, 8, 10, 5.0, NOW - 26 * h),
        ],
    )


def test_dash_stats_and_empty_summary(spark):
    s = D.dash_stats(_rows(spark).filter("prediction is not null and not isnan(prediction)")).first()
    assert s["total_predictions"] == 5 and s["unique_users"] == 2
    assert s["avg_prediction"] == round((4.5 + 3.0 + 3.0 + 2.0 + 5.0) / 5, 2)
    empty = D.dash_summary(_p(spark, []), NOW).first()
    assert empty["total_predictions"] == 0 and empty["avg_rating"] is None and empty["active_users_24h"] == 0


def test_item_stats_unknown_item_gives_no_row(spark):
    p = _rows(spark)
    assert D.dash_item_stats(p, 999).count() == 0
    r = D.dash_item_stats(p, 10).first()
    assert (r["count_ratings"], r["max_rating"], r["min_rating"]) == (3, 5.0, 2.0)


def test_top_items_min_count_and_ties(spark):
    p = _p(spark, [(i, 1, m, v, NOW) for i, (m, v) in enumerate([(3, 4.0), (3, 4.0), (2, 4.0), (2, 4.0), (1, 5.0)])])
    got = [(r["movieId"], r["total_ratings"]) for r in D.dash_top_items(p, min_count=2, k=10).collect()]
    assert got == [(2, 2), (3, 2)]


def test_activity_and_trends_last_24h(spark):
    p = _rows(spark)
    act = {r["hour"]: r["n_predictions"] for r in D.dash_activity(p, NOW).collect()}
    assert act == {10: 1, 11: 1, 12: 1, 9: 1, 13: 1}
    tr = {r["hour"]: r["n_predictions"] for r in D.dash_trends(p, NOW).collect()}
    assert tr == act
    s = D.dash_summary(p, NOW).first()
    assert s["active_users_24h"] == 2 and s["total_predictions"] == 7
    assert D.dash_summary(p, NOW, approx_users=True).first()["active_users_24h"] == 2
    assert D.dash_stats(p, approx_users=True).first()["unique_users"] == 2


def test_latest_tie_break(spark):
    p = _p(spark, [(1, 1, 1, 1.0, NOW), (2, 1, 1, 1.0, NOW), (3, 1, 1, 1.0, NOW - dt.timedelta(seconds=1))])
    assert [r["event_id"] for r in D.latest(p, 2).collect()] == [2, 1]
    assert D.latest(p, 2, columns=["userId", "movieId", "prediction", "ts"]).columns == [
        "userId",
        "movieId",
        "prediction",
        "ts",
    ]


def test_distribution_drops_missing(spark):
    got = {r["prediction"]: r["n_predictions"] for r in D.dash_distribution(_rows(spark)).collect()}
    assert got == {2.0: 1, 3.0: 2, 4.5: 1, 5.0: 1}


def test_user_top_missing_scores_last(spark):
    got = D.user_top(_rows(spark), 7, k=5).collect()
    assert [r["event_id"] for r in got] == [1, 2, 5, 3, 4]
    assert len(D.user_top(_rows(spark), 7, k=2).collect()) == 2


def test_user_top_all_matches_plain_window_under_skew(spark):
    # user 0 holds most rows (a hot key); equal scores exercise the tie-break
    rows = [(i, 0 if i % 3 else (i % 11), i % 17, float((i * 7) % 13), NOW) for i in range(3000)]
    rows.append((5000, 3, 1, float("nan"), NOW))
    p = _p(spark, rows)
    got = {(r["userId"], r["rank"]): r["event_id"] for r in D.user_top_all(p, 5).collect()}
    key = F.nanvl("prediction", F.lit(None).cast("double")).desc_nulls_last()
    w = Window.partitionBy("userId").orderBy(key, F.col("event_id"))
    ref = p.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    want = {(r["userId"], r["rank"]): r["event_id"] for r in ref.collect()}
    assert got == want


def test_resolve_as_of(spark):
    assert D.resolve_as_of(_rows(spark)) == NOW
    assert D.resolve_as_of(_p(spark, [])) is None
    dated = _rows(spark).withColumn("d", F.to_date("ts"))
    assert D.resolve_as_of(dated, date_col="d") == NOW
    assert D.resolve_as_of(dated.limit(0), date_col="d") is None


def test_nan_average_propagates(spark):
    r = D.dash_item_stats(_rows(spark), 12).first()
    assert math.isnan(r["avg_rating"])


def test_empty_tables_have_empty_windows(spark):
    p = _p(spark, [])
    assert D.dash_activity(p, None).count() == D.dash_trends(p, None).count() == 0
    s = D.dash_summary(p, None).first()
    assert (s["total_predictions"], s["active_users_24h"], s["avg_rating"]) == (0, 0, None)


def test_bound_is_pushed_to_the_scan(spark, tmp_path):
    _rows(spark).write.parquet(str(tmp_path / "p"))
    for zoned in (False, True):
        p = spark.read.parquet(str(tmp_path / "p"))
        if zoned:
            p.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "z"))
            p = spark.read.parquet(str(tmp_path / "z"))
        plan = D.dash_activity(p, NOW)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan.replace("`", "")


def test_zoned_as_of_is_taken_to_utc(spark):
    east = NOW.replace(tzinfo=dt.timezone.utc).astimezone(dt.timezone(dt.timedelta(hours=9)))
    assert D.dash_activity(_rows(spark), east).collect() == D.dash_activity(_rows(spark), NOW).collect()


def test_user_top_size(spark):
    assert D.user_top_size(_rows(spark), 7, 5).first()["n_items"] == 5
    assert D.user_top_size(_rows(spark), 7, 2).first()["n_items"] == 2
    assert D.user_top_size(_rows(spark), 999).first()["n_items"] == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_windows_do_not_depend_on_the_machine_zone(zone):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "import duckdb, __spark_entry__ as E\n"
        "from ratelake.session import build_session\n"
        "spark = build_session('local[2]', shuffle_partitions=2)\n"
        "con = duckdb.connect()\n"
        "for t in ('events', 'embeddings'): con.execute(f\"CREATE VIEW {t} AS SELECT * FROM read_parquet('%s/{t}.parquet')\")\n"
        "for q in ('dash_activity_24h', 'dash_trends_24h', 'dash_summary', 'store_trends_24h'):\n"
        "    df = E.queries()[q](spark, '%s')\n"
        "    cur = con.execute(E.oracle_sql()[q]); names = [c[0] for c in cur.description]\n"
        "    norm = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)\n"
        "    assert norm(map(tuple, df.select(*names).collect())) == norm(cur.fetchall()), q\n"
        "print('SAME')\n"
    ) % (ROOT, SF_SMALL, SF_SMALL)
    env = {**os.environ, "TZ": zone, "PYTHONPATH": os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=600)
    assert "SAME" in done.stdout, done.stderr[-2000:]
