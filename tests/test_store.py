"""The managed prediction store and the stored message log."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ratelake import jobs
from ratelake.operators import dashboard as D
from ratelake.sources import files as FS
from ratelake.streaming import log as LG
from ratelake.streaming import messages as SM
from ratelake.streaming import panels as P
from ratelake.streaming import store as ST
from ratelake.streaming.store import PredictionStore, grid_cell, write_clustered

SCHEMA = "userId int, movieId int, prediction double, timestamp timestamp"
DAY = dt.datetime(2024, 1, 1, 6)


def _epoch(spark, path, query, number, rows):
    """What the epoch writer leaves of one micro-batch."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("event_date", F.to_date("timestamp")).withColumn("epoch", F.lit(f"{query}-{number}"))
    writer = df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_date", "epoch").parquet(path)


def _rows(n, day=0, days=1):
    return [(i % 13, i % 7, i / 8, DAY + dt.timedelta(days=day + i % days, seconds=i)) for i in range(n)]


def _content(df):
    return sorted(map(str, df.select("userId", "movieId", "prediction", "timestamp", "event_date").collect()))


def test_folding_keeps_every_row_and_bounds_the_files(spark, tmp_path):
    path = str(tmp_path / "store")
    store, expected, most = PredictionStore(spark, path), [], 0
    for number in range(12):
        rows = _rows(20, days=2) + [(1, 2, 0.5, None)]
        _epoch(spark, path, "q", number, rows)
        expected += rows
        if number % 3 == 2:
            before = _content(store.read())
            assert store.compact(fan_in=3) is not None
            assert _content(store.read()) == before and len(before) == len(expected)
            store.vacuum(grace_seconds=0)
            assert _content(store.read()) == before
            most = max(most, len(list((tmp_path / "store").rglob("*.parquet"))))
    # three dates of at most two segments of one file each, and the open epoch's three
    m = store.manifest()
    assert most <= 3 * 2 + 3 + 3 and len(m.segments) <= 6 and m.folded == {"q": 10}
    assert sum(s["rows"] for s in m.segments) == 11 * 21 and store.dates() == ["2024-01-02", "2024-01-01", ""]
    assert [e[3] for e in store._epochs()] == [11] * 3  # folded folders are gone
    assert store.compact() is None  # the newest epoch may still be replayed


def test_folded_epochs_count_once_when_they_are_replayed(spark, tmp_path):
    path = str(tmp_path / "store")
    store = PredictionStore(spark, path)
    for number in range(3):
        _epoch(spark, path, "a", number, _rows(10, day=number))
        _epoch(spark, path, "b", number, _rows(4, day=number))
    want = _content(store.read())
    store.compact()
    store.vacuum(grace_seconds=0)
    for number in (2, 1, 0):  # an old checkpoint is restored: even folded epochs are written again
        _epoch(spark, path, "a", number, _rows(10, day=number))
    assert _content(store.read()) == want
    store.compact()
    assert _content(store.read()) == want
    store.vacuum(grace_seconds=0)
    assert _content(store.read()) == want and sorted({e[3] for e in store._epochs()}) == [2]


def test_a_running_reader_survives_folding_and_two_folds_collide(spark, tmp_path):
    path = str(tmp_path / "store")
    store = PredictionStore(spark, path)
    for number in range(3):
        _epoch(spark, path, "a", number, _rows(10, days=3))
    old = store.read()
    m = store.manifest()
    store.compact()
    assert old.count() == 30  # planned before the fold; its folders stay until vacuum
    assert store.vacuum() == 0 and old.count() == 30
    with pytest.raises(FS.FileConflict):
        store._publish(m)  # a fold that started from the older version
    assert not [n for n in os.listdir(tmp_path / "store" / "_manifest") if n.endswith(".new")]


def test_streamed_epochs_are_folded_by_their_checkpoint(spark, tmp_path):
    src, path, ck = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "ck")
    src.mkdir()

    def run(name):
        with open(src / name, "w") as fh:
            for i in range(6):
                message = {"userId": i, "movieId": 2, "rating": 1.0, "timestamp": 1706608800 + i}
                fh.write(json.dumps({"value": json.dumps(message)}) + "\n")
        hook = SM.epoch_writer(path, str(tmp_path / "rejects"), lambda df: df.drop("value").withColumn("event_date", F.to_date("timestamp")))
        stream = SM.message_stream(spark, fmt="json", schema="value string", path=str(src))
        parsed = SM.parse_messages(stream, keep=("value",))
        SM.run_available(SM.start_stream(parsed, foreach_batch=hook, checkpoint=ck, trigger={"availableNow": True}))

    store = PredictionStore(spark, path)
    run("a.json")
    run("b.json")
    assert store.compact() is not None and sorted({e[3] for e in store._open(store.manifest())}) == [1]
    assert store.compact() is None and store.compact(checkpoints=[ck]) is not None
    run("c.json")
    os.remove(os.path.join(ck, "commits", "2"))
    os.remove(os.path.join(ck, "commits", ".2.crc"))
    assert store.compact(checkpoints=[ck]) is None  # its commit is missing: the batch will run again
    run("d.json")
    assert store.read().count() == 24 and store.compact(checkpoints=[ck]) is not None and store.read().count() == 24


def _scanned(df):
    """Rows that left the Parquet readers of a finished plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_latest_opens_only_the_newest_dates(spark, tmp_path):
    path = str(tmp_path / "store")
    store = PredictionStore(spark, path)
    for number in range(2):
        _epoch(spark, path, "a", number, _rows(600, days=30) + [(5, 5, 1.0, None)])
    for fold in (False, True):
        if fold:
            store.compact()
        for k, dates in ((10, 1), (41, 2), (10_000, 31)):
            got = store.latest(k, tie=("movieId", "userId"))
            want = D.latest(store.read(), k, ts="timestamp", tie=("movieId", "userId"))
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.select(got.columns).collect()]
            assert len({f.split("event_date=")[1].split("/")[0] for f in got.inputFiles()}) == dates
            assert _scanned(got) <= dates * 40 + 2
    window = store.since(DAY + dt.timedelta(days=29, hours=3))
    assert window.count() == D.last_hours(store.read(), DAY + dt.timedelta(days=29, hours=3), 24, "timestamp").count() > 0
    assert len({f.split("event_date=")[1].split("/")[0] for f in window.inputFiles()}) == 2


def test_lookups_read_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "store")
    store = PredictionStore(spark, path)
    rows = spark.range(200_000).select(
        (F.xxhash64("id") % 5000).cast("int").alias("userId"), (F.xxhash64("id", F.lit(1)) % 5000).cast("int").alias("movieId"),
        (F.col("id") % 64 / 8).alias("prediction"), F.lit(DAY).alias("timestamp"), F.lit("q-0").alias("epoch"),
    ).withColumn("event_date", F.to_date("timestamp"))
    rows.write.partitionBy("event_date", "epoch").parquet(path)
    _epoch(spark, path, "q", 1, _rows(1))
    wide = store.read().where("movieId = 42")
    assert _scanned(wide) > 150_000
    item, user = store.item_stats(42).collect(), store.user_top(7).collect()
    store.compact(row_group_bytes=64 << 10, file_bytes=1 << 20)
    assert store.item_stats(42).collect() == item and store.user_top(7).collect() == user
    for condition in ("movieId = 42", "userId = 7"):
        assert 0 < _scanned(store.read().where(condition)) < 60_000
    assert _scanned(store.read().where("movieId = 999999")) < 20_000


def test_a_hot_pair_spreads_over_files(spark, tmp_path):
    rows = spark.range(30_000).select(F.lit(1).alias("userId"), F.lit(2).alias("movieId"), F.rand(1).alias("prediction"), F.lit(DAY.date()).alias("event_date"))
    write_clustered(rows, str(tmp_path / "t"), files=6)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 3 * min(sizes)
    cells = spark.range(4096).select(grid_cell("id", F.col("id") * 7, bits=3).alias("c")).distinct().collect()
    assert {r.c for r in cells} == set(range(64))


def test_store_without_epochs_or_rows(spark, tmp_path):
    empty = PredictionStore(spark, str(tmp_path / "none"))
    assert empty.read().count() == 0 and empty.dates() == [] and empty.compact() is None and empty.latest().count() == 0 and empty.vacuum() == 0
    loose = str(tmp_path / "loose")
    spark.createDataFrame(_rows(50, days=5), SCHEMA).withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(loose)
    store = PredictionStore(spark, loose)
    assert store.read().count() == 50 and len(store.dates()) == 5 and store.compact() is None
    assert store.latest(3).collect() == D.latest(store.read(), 3, "timestamp", ("movieId", "userId")).collect()
    assert jobs.dashboard(spark, loose, as_of="latest", user_id=1)["recent"].count() == 10


def test_compact_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from ratelake.__main__ import main

    path = str(tmp_path / "store")
    for number in range(3):
        _epoch(spark, path, "q", number, _rows(5))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)  # the shared test session
    assert main(["compact", "--store", path, "--vacuum-hours", "0"]) == 0 and main(["compact", "--store", path]) == 0
    out = capsys.readouterr().out
    assert "version 1: 1 segments (2 folders deleted)" in out and "nothing to fold" in out
    assert PredictionStore(spark, path).read().count() == 15


# ---- the message log ----


def _messages(spark, values, key="k"):
    return spark.createDataFrame([(f"{key}{v % 5}", str(v), v) for v in values], "key string, value string, at int")


def _stream(spark, path, out, ck, start="earliest", **options):
    stream = SM.message_stream(spark, fmt=LG.register(spark), options={"path": path, **options}, starting_offsets=start)
    return SM.start_stream(stream, path=str(out), checkpoint=str(ck), trigger={"processingTime": "0 seconds"})


def test_offsets_are_gapless_and_keep_the_order_of_a_key(spark, tmp_path):
    path = str(tmp_path / "log")
    assert LG.append_messages(_messages(spark, range(100)), path, partitions=3, order_by=("at",)) == 0
    assert LG.append_messages(_messages(spark, range(100, 130)), path, partitions=3, order_by=("at",)) == 1
    rows = spark.read.parquet(*FS.matching(spark, f"{path}/segment=*")).select("partition", "offset", F.col("key").cast("string"), F.col("value").cast("string").cast("int").alias("value")).collect()
    ends = LG.log_ends(spark, path)
    assert sum(ends.values()) == 130 and sorted((r.partition, r.offset) for r in rows) == [(p, o) for p in sorted(ends) for o in range(ends[p])]
    for key in {r.key for r in rows}:
        own = sorted((r.offset, r.value) for r in rows if r.key == key)
        assert len({r.partition for r in rows if r.key == key}) == 1 and [v for _, v in own] == sorted(v for _, v in own)


@pytest.mark.parametrize("start", ["earliest", "latest"])
def test_a_stream_starts_where_it_is_told_and_goes_on_after_a_restart(spark, tmp_path, start):
    path, out, ck = str(tmp_path / "log"), tmp_path / "out", tmp_path / "ck"
    LG.append_messages(_messages(spark, range(40)), path)
    for more in (range(40, 60), range(60, 61), None):
        query = _stream(spark, path, out, ck, start)
        query.processAllAvailable()
        if more:
            LG.append_messages(_messages(spark, more), path)
            query.processAllAvailable()
        query.stop()
    got = sorted(int(r.value) for r in spark.read.parquet(str(out)).select(F.col("value").cast("string")).collect())
    assert got == list(range(0 if start == "earliest" else 40, 61))


def test_micro_batches_are_bounded_also_after_a_restart(spark, tmp_path):
    path, ck, sizes = str(tmp_path / "log"), str(tmp_path / "ck"), []
    options = {"path": path, "maxOffsetsPerTrigger": "15", "group": "g"}
    for n in range(3):
        LG.append_messages(_messages(spark, range(50 * n, 50 * n + 50)), path)
        stream = SM.message_stream(spark, fmt=LG.register(spark), options=options, starting_offsets="earliest")
        query = SM.start_stream(stream, foreach_batch=lambda df, e: sizes.append((e, df.count())), checkpoint=ck, trigger={"processingTime": "0 seconds"})
        query.processAllAvailable()
        query.stop()
        if n == 1:  # the last micro-batch was not committed: it runs again, and nothing is lost or doubled after it
            last = max(os.listdir(tmp_path / "ck" / "commits"), key=lambda name: int(name) if name.isdigit() else -1)
            os.remove(tmp_path / "ck" / "commits" / last)
            os.remove(tmp_path / "ck" / "commits" / f".{last}.crc")
    by_epoch = dict(sizes)
    assert sum(by_epoch.values()) == 150 and max(by_epoch.values()) <= 15 and len(sizes) == len(by_epoch) + 1


def test_bad_options_fail(spark, tmp_path):
    LG.append_messages(_messages(spark, range(3)), str(tmp_path / "log"))
    for options, message in (({"maxOffsetsPerTrigger": "5"}, "needs a group"), ({"startingOffsets": "middle"}, "earliest or latest")):
        reader = spark.readStream.format(LG.register(spark)).option("path", str(tmp_path / "log")).options(**options)
        with pytest.raises(StreamingQueryException, match=message):
            query = reader.load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / message)).start()
            query.processAllAvailable()


def test_readers_get_only_their_offsets(spark, tmp_path):
    path = str(tmp_path / "log")
    LG.append_messages(_messages(spark, range(200)), path, partitions=2)
    LG.append_messages(_messages(spark, range(200, 220)), path, partitions=2)
    reader = LG.LogReader({"path": path, "startingOffsets": "earliest"})
    ends = reader.latestOffset()
    start = {p: e - 5 for p, e in ends.items()}
    spans = reader.partitions(start, ends)
    rows = [r for span in spans for batch in reader.read(span) for r in batch.to_pylist()]
    assert sorted((r["partition"], r["offset"]) for r in rows) == sorted((int(p), o) for p, e in ends.items() for o in range(e - 5, e))
    assert reader.partitions(ends, ends) == [] and all("segment=00000001" in s.file for s in spans)


def test_an_append_is_numbered_in_ranges_and_read_in_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LG, "RANGE_ROWS", 100)
    monkeypatch.setattr(LG, "SPAN_ROWS", 40)
    path = str(tmp_path / "log")
    rows = [(f"k{i % 3}".encode() if i % 5 else None, f"v{i % 7}".encode(), i) for i in range(1000)]  # many equal messages
    df = spark.createDataFrame(rows, "key binary, value binary, i int")
    LG.append_messages(df, path, partitions=2, order_by=("i",))
    LG.append_messages(df.where("i < 500"), path, partitions=2, order_by=("i",))
    LG.append_messages(df.limit(0), path, partitions=2)
    back = spark.read.schema(LG.SCHEMA).parquet(f"{path}/segment=00000000", f"{path}/segment=00000001")
    assert back.count() == 1500 and len(back.select(F.input_file_name()).distinct().collect()) >= 10
    ends = LG.log_ends(spark, path)
    for p in range(2):
        own = [r["offset"] for r in back.where(F.col("partition") == p).select("offset").collect()]
        assert sorted(own) == list(range(ends.get(p, 0)))
    first = spark.read.schema(LG.SCHEMA).parquet(f"{path}/segment=00000000").orderBy("partition", "offset").collect()
    for p in range(2):
        for key in (None, b"k0", b"k1", b"k2"):
            got = [bytes(r["value"]) for r in first if r["partition"] == p and (r["key"] and bytes(r["key"])) == key]
            mine = [v for k, v, _ in rows if k == key]
            assert not got or key is None or got == mine  # a key's messages lie in one partition, in order
    reader = LG.LogReader({"path": path, "startingoffsets": "earliest"})
    spans = reader.partitions({}, reader.latestOffset())
    assert max(s.last - s.first for s in spans) < 40
    read = [tuple(r) for s in spans for b in reader.read(s) for r in zip(b.column("partition").to_pylist(), b.column("offset").to_pylist(), strict=True)]
    assert len(read) == 1500 == len(set(read))


def test_a_fold_deals_rows_and_cells_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "FILE_ROWS", 50)
    path = str(tmp_path / "store")
    for number in range(2):
        _epoch(spark, path, "q", number, [(i, i, i / 8, DAY + dt.timedelta(seconds=i)) for i in range(300)])
        P.write(P.partials(spark.read.parquet(path).where(F.col("epoch") == f"q-{number}")), f"{path}/_panels/epoch=q-{number}")
    store = PredictionStore(spark, path)
    before = _content(store.read())
    m = store.compact()
    assert _content(store.read()) == before and m.pieces
    for folder in (f"{path}/_folded/*/*", f"{path}/_panels/piece=*/*"):
        files = spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()
        assert len(files) >= 4 and max(r["count"] for r in files) <= 100
    assert store.panel_stats().first()["total_predictions"] == 600
