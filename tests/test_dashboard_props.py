"""Dashboard operators against brute force on random small tables."""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ratelake.operators import dashboard as D

SCHEMA = "event_id long, userId int, movieId int, prediction double, ts timestamp"
T0 = dt.datetime(2024, 1, 1)

score = st.one_of(st.sampled_from([1.0, 2.5, 2.5, 4.0, 5.0]), st.just(float("nan")), st.none())
row = st.tuples(st.integers(0, 3), st.integers(0, 4), score, st.integers(0, 72 * 60))
tables = st.lists(row, min_size=0, max_size=40)


def _frame(spark, rows):
    data = [(i, u, m, p, T0 + dt.timedelta(minutes=t)) for i, (u, m, p, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA), data


def _key(p):
    # descending score with missing last, as the operators rank
    return (1, 0.0) if p is None or math.isnan(p) else (0, -p)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=tables)
def test_dashboard_matches_brute_force(spark, rows):
    df, data = _frame(spark, rows)

    # top items: mean (NaN propagates), count >= 2, ties by id
    groups = defaultdict(list)
    for _, _, m, p, _ in data:
        groups[m].append(p)
    items = []
    for m, ps in groups.items():
        vals = [p for p in ps if p is not None]
        mean = (sum(vals) / len(vals)) if vals else None
        if len(ps) >= 2:
            items.append((m, mean, len(ps)))
    got = [(r["movieId"], r["total_ratings"]) for r in D.dash_top_items(df, 2, 3).collect()]

    def order(t):
        mean = t[1]
        if mean is None or math.isnan(mean):
            return (1, 0.0, t[0])  # missing means rank last
        return (0, -mean, t[0])

    want = [(m, n) for m, _, n in sorted(items, key=order)[:3]]
    assert got == want

    # one user's best 3, missing scores last, ties by event id
    mine = sorted((r for r in data if r[1] == 1), key=lambda r: (_key(r[3]), r[0]))[:3]
    assert [r["event_id"] for r in D.user_top(df, 1, 3).collect()] == [r[0] for r in mine]

    # every user's best 2 
    allk = {(r["userId"], r["rank"]): r["event_id"] for r in D.user_top_all(df, 2).collect()}
    want_all = {}
    for u in {r[1] for r in data}:
        ranked = sorted((r for r in data if r[1] == u), key=lambda r: (_key(r[3]), r[0]))[:2]
        for i, r in enumerate(ranked, 1):
            want_all[(u, i)] = r[0]
    assert allk == want_all

    # value distribution without missing values
    dist = {r["prediction"]: r["n_predictions"] for r in D.dash_distribution(df).collect()}
    want_dist = defaultdict(int)
    for r in data:
        if r[3] is not None and not math.isnan(r[3]):
            want_dist[r[3]] += 1
    assert dist == dict(want_dist)

    # hourly activity in the 24 h before the newest row
    if data:
        as_of = max(r[4] for r in data)
        act = {r["hour"]: r["n_predictions"] for r in D.dash_activity(df, as_of).collect()}
        want_act = defaultdict(int)
        for r in data:
            if r[4] >= as_of - dt.timedelta(hours=24):
                want_act[r[4].hour] += 1
        assert act == dict(want_act)
