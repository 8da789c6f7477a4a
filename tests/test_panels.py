"""Partial aggregates of the store: every panel from cells equals the panel over the rows."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from ratelake.operators import dashboard as D
from ratelake.sources import files as FS
from ratelake.streaming import messages as SM
from ratelake.streaming import panels as P
from ratelake.streaming.store import PredictionStore

SCHEMA = "userId int, movieId int, prediction double, timestamp timestamp"
START = dt.datetime(2024, 1, 1, 6)


def _epoch(spark, path, number, rows, cells=True):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("event_date", F.to_date("timestamp"))
    out = df.withColumn("epoch", F.lit(f"q-{number}")).coalesce(1)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "epoch").parquet(path)
    if cells:
        P.write(P.partials(df), f"{path}/_panels/epoch=q-{number}")


def _rows(n, at=0, step=700):
    """Users, items, quarters as scores; some rows without a score, with NaN, or without a time."""
    score = lambda i: None if i % 11 == 3 else float("nan") if i % 29 == 5 and i % 5 == 1 else (i % 16) / 4
    when = lambda i: None if i % 17 == 9 else START + dt.timedelta(seconds=step * (at + i))
    return [((at + i) % 9 if i % 4 else 1, i % 5, score(i), when(i)) for i in range(n)]


def _plain(df):
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return [tuple(clean(v) for v in r) for r in df.collect()]


def _agree(store):
    rows, as_of = store.read(), store.newest()
    assert _plain(store.panel_stats()) == _plain(D.dash_stats(rows))
    assert _plain(store.panel_top_items(3, 4)) == _plain(D.dash_top_items(rows, 3, 4))
    assert _plain(store.panel_distribution()) == _plain(D.dash_distribution(rows))
    for hours in (24, 30):
        trends = D.dash_trends(rows, as_of, hours, ts="timestamp")
        assert _plain(store.panel_trends(as_of, hours)) == _plain(trends)
        summary = D.dash_summary(rows, as_of, hours, ts="timestamp")
        assert _plain(store.panel_summary(as_of, hours)) == _plain(summary)
    (few,), (exact,) = store.panel_stats(approx_users=True).collect(), store.panel_stats().collect()
    assert few["unique_users"] == exact["unique_users"]  # sketches of so few users are exact
    assert store.panel_summary(as_of, approx_users=True).collect() == store.panel_summary(as_of).collect()


def test_panels_equal_the_rows_before_and_after_folding(spark, tmp_path):
    path = str(tmp_path / "store")
    store = PredictionStore(spark, path)
    for number in range(5):
        _epoch(spark, path, number, _rows(40, at=40 * number), cells=number not in (1, 3))  # cells may lack
        if number in (2, 3):
            _agree(store)
            store.compact(fan_in=2)
            store.vacuum(grace_seconds=0)
    _agree(store)
    m = store.manifest()
    assert m.pieces and sum(p["rows"] for p in m.pieces) <= P.partials(store.read()).count() * 2
    assert len(FS.matching(spark, f"{path}/_panels/piece=*")) == len(m.pieces)
    # the folded epochs' cells are gone with their rows
    assert {f.rsplit("-", 1)[1] for f in FS.matching(spark, f"{path}/_panels/epoch=*")} == {"4"}


def test_a_replay_replaces_cells_and_a_folded_epoch_counts_once(spark, tmp_path):
    path = str(tmp_path / "store")
    store = PredictionStore(spark, path)
    for number in range(3):
        _epoch(spark, path, number, _rows(20, at=20 * number))
    _epoch(spark, path, 2, _rows(11, at=7))  # the newest epoch runs again, with other scores
    _agree(store)
    store.compact()
    before = _plain(store.panel_stats())
    _epoch(spark, path, 0, _rows(20))  # an old checkpoint is restored
    assert _plain(store.panel_stats()) == before
    _agree(store)
    store.vacuum(grace_seconds=0)
    assert not FS.exists(spark, f"{path}/_panels/epoch=q-0")
    _agree(store)


def test_pieces_merge_by_size(spark, tmp_path):
    path = str(tmp_path / "store")
    store, most = PredictionStore(spark, path), 0
    for number in range(9):
        _epoch(spark, path, number, _rows(12, at=12 * number))
        store.compact(fan_in=2)
        most = max(most, len(store.manifest().pieces))
    assert most <= 4  # not one for each of eight folds
    _agree(store)


def test_a_store_folded_without_cells_and_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    empty = PredictionStore(spark, str(tmp_path / "none"))
    assert empty.newest() is None
    assert _plain(empty.panel_stats()) == [(0, None, 0)] and _plain(empty.panel_summary(None)) == [(0, 0, None)]
    assert _plain(empty.panel_top_items()) == [] and _plain(empty.panel_stats(approx_users=True)) == [(0, None, 0)]
    assert _plain(empty.panel_trends(START)) == []
    store = PredictionStore(spark, path)
    for number in range(4):
        _epoch(spark, path, number, _rows(20, at=20 * number), cells=number > 2)
        if number == 1:
            assert store.compact().segments and not store.manifest().pieces
    _agree(store)
    store.compact()  # the stream writes cells by now: segments get theirs
    assert store.manifest().pieces
    _agree(store)


def test_panels_read_cells_and_only_the_window_s_first_hour_of_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    store = PredictionStore(spark, path)
    for number in range(6):
        _epoch(spark, path, number, _rows(100, at=100 * number))
    store.compact()
    for panel in (store.panel_stats(), store.panel_top_items(), store.panel_distribution()):
        assert all("/_panels/" in f for f in panel.inputFiles()) and panel.inputFiles()
    as_of = store.newest()
    day = (as_of - dt.timedelta(hours=24)).date().isoformat()
    rows = [f for f in store.panel_trends(as_of).inputFiles() if "/_panels/" not in f]
    assert rows and all(f"event_date={day}" in f for f in rows)


def test_the_stream_writes_cells_with_its_rows(spark, tmp_path):
    src, path = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    for part in range(3):
        with open(src / f"{part}.json", "w") as fh:
            for i in range(30):
                message = {"userId": i % 7, "movieId": i % 4, "rating": 1.0, "timestamp": 1706608800 + 900 * i}
                fh.write(json.dumps({"value": json.dumps(message)}) + "\n")

    def to_store(df):
        return df.select("userId", "movieId", (F.col("userId") / 4).alias("prediction"), "timestamp", F.to_date("timestamp").alias("event_date"))

    hook = SM.epoch_writer(path, str(tmp_path / "rejects"), to_store, panels=True)
    stream = SM.message_stream(spark, fmt="json", schema="value string", path=str(src), options={"maxFilesPerTrigger": "1"})
    parsed = SM.parse_messages(stream, keep=("value",))
    SM.run_available(SM.start_stream(parsed, foreach_batch=hook, checkpoint=str(tmp_path / "ck"), trigger={"availableNow": True}))
    store = PredictionStore(spark, path)
    assert len(FS.matching(spark, f"{path}/_panels/epoch=*/_SUCCESS")) == 3
    assert all("/_panels/" in f for f in store.panel_stats().inputFiles())
    _agree(store)
    assert store.panel_stats().first()["total_predictions"] == 90


@pytest.mark.parametrize("as_of", [dt.datetime(2024, 1, 2, 6), dt.datetime(2024, 1, 2, 6, 0, 0, 1)])
def test_the_window_s_edge(as_of):
    start, full = P.window_edge(as_of)
    assert start == as_of - dt.timedelta(hours=24)
    assert full == (start if as_of.microsecond == 0 else dt.datetime(2024, 1, 1, 7))
