from __future__ import annotations

import datetime as dt
import json
import os
from functools import partial

import pytest
from pyspark.sql import functions as F

from ratelake.operators import model as M
from ratelake.streaming import messages as SM
from tests.conftest import SF_SMALL

MESSAGES = [
    json.dumps({"userId": 1, "movieId": 2, "rating": 3.5, "timestamp": 1700000000}),
    json.dumps({"userId": 1, "movieId": 3, "rating": 4.0, "timestamp": "2024-01-30T10:11:12.123456"}),
    json.dumps({"userId": 2, "movieId": 3, "rating": 2.5}),
    json.dumps({"userId": "abc", "movieId": 3, "rating": 2.5}),
    json.dumps({"userId": 3_000_000_000, "movieId": 3, "rating": 2.5}),
    json.dumps({"userId": 4, "movieId": 5, "rating": "high"}),
    "this is not json",
    None,
]


def _batch(spark, values=MESSAGES):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_json_shapes(spark):
    rows = SM.parse_messages(_batch(spark)).collect()
    assert rows[0]["timestamp"] == dt.datetime(2023, 11, 14, 22, 13, 20)  # epoch seconds, UTC
    assert rows[1]["timestamp"] == dt.datetime(2024, 1, 30, 10, 11, 12, 123456)
    assert rows[2]["timestamp"] is None and rows[2]["userId"] == 2
    assert rows[3]["userId"] is None and rows[3]["movieId"] == 3  # bad field only
    assert rows[4]["userId"] is None  # overflows int
    assert rows[5]["rating"] is None and rows[5]["userId"] == 4
    assert all(v is None for v in rows[6].asDict().values())
    assert all(v is None for v in rows[7].asDict().values())


def test_split_valid_routes_bad_ids(spark):
    ok, bad = SM.split_valid(SM.parse_messages(_batch(spark)))
    assert ok.count() == 4 and bad.count() == 4
    _, bad_raw = SM.split_valid(SM.parse_messages(_batch(spark), keep=("value",)))
    assert "this is not json" in [r["value"] for r in bad_raw.collect()]


def test_decode_binary_key_value(spark):
    df = spark.createDataFrame([(b"k1", b'{"userId": 1}')], "key binary, value binary")
    got = SM.decode_messages(df).first()
    assert got["key"] == "k1" and got["value"] == '{"userId": 1}'
    assert SM.parse_messages(df).first()["userId"] == 1


def test_starting_offsets_validated(spark):
    with pytest.raises(ValueError):
        SM.message_stream(spark, starting_offsets="middle")


def _write_json_lines(folder, values, name):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        for v in values:
            fh.write(json.dumps({"value": v}) + "\n")


def _stream_of(spark, folder):
    return SM.message_stream(spark, fmt="json", schema="value string", path=folder)


def test_stream_equals_batch_and_rerun_adds_nothing(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    values = [m for m in MESSAGES if m is not None]
    _write_json_lines(src, values, "part-0.json")

    def run():
        parsed = SM.parse_messages(_stream_of(spark, src))
        q = SM.start_stream(parsed, sink="parquet", path=out, checkpoint=ck, trigger={"availableNow": True})
        SM.run_available(q)

    run()
    streamed = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
    batch = sorted(map(tuple, SM.parse_messages(_batch(spark, values)).collect()), key=repr)
    assert streamed == batch
    run()  # same checkpoint: nothing new to process
    assert spark.read.parquet(out).count() == len(values)
    _write_json_lines(src, values[:2], "part-1.json")
    run()  # only the new file is read
    assert spark.read.parquet(out).count() == len(values) + 2


def test_stream_scoring_with_factor_tables_and_reject_sink(spark, tmp_path):
    src = str(tmp_path / "src")
    _write_json_lines(src, MESSAGES[:6], "p.json")
    f = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [0.5, 0.5])], "id int, features array<float>")
    parsed = SM.parse_messages(_stream_of(spark, src))
    valid, rejected = SM.split_valid(parsed)
    scorer = partial(M.score_factors, user_factors=f, item_factors=f)
    scored = SM.score_stream(valid, scorer)
    queries = SM.start_many(
        [
            (scored, dict(sink="parquet", path=str(tmp_path / "scored"), checkpoint=str(tmp_path / "c1"),
                          trigger={"availableNow": True}, partition_by=None)),
            (rejected, dict(sink="parquet", path=str(tmp_path / "rejects"), checkpoint=str(tmp_path / "c2"),
                            trigger={"availableNow": True})),
        ]
    )
    for q in queries:
        SM.run_available(q)
    got = {(r["userId"], r["movieId"]): r["prediction"] for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    assert got == {(1, 2): 2.0, (1, 3): 1.0, (2, 3): 1.0, (4, 5): None}
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 2


def test_foreach_batch_hook_and_memory_console_sinks(spark, tmp_path):
    src = str(tmp_path / "src")
    _write_json_lines(src, MESSAGES[:3], "p.json")
    seen = []

    def hook(df, epoch_id):
        seen.append((epoch_id, df.count()))

    parsed = SM.parse_messages(_stream_of(spark, src))
    SM.run_available(
        SM.start_stream(parsed, foreach_batch=hook, checkpoint=str(tmp_path / "ck"), trigger={"availableNow": True})
    )
    assert sum(n for _, n in seen) == 3 and seen[0][0] == 0
    with pytest.raises(ValueError):
        SM.start_stream(parsed, foreach_batch=hook)

    mem = SM.start_stream(parsed, sink="memory", query_name="parsed_mem", trigger={"availableNow": True})
    SM.run_available(mem)
    assert spark.table("parsed_mem").count() == 3
    con = SM.start_stream(parsed.select("userId"), sink="console", trigger={"processingTime": "2 seconds"})
    con.processAllAvailable()
    con.stop()


def test_stream_partitioned_store(spark, tmp_path):
    src = str(tmp_path / "src")
    _write_json_lines(src, MESSAGES[:2], "p.json")
    parsed = SM.parse_messages(_stream_of(spark, src)).withColumn("event_date", F.to_date("timestamp"))
    out = str(tmp_path / "store")
    SM.run_available(
        SM.start_stream(parsed, path=out, checkpoint=str(tmp_path / "ck"), trigger={"availableNow": True},
                        partition_by=["event_date"])
    )
    dates = sorted(str(r["event_date"]) for r in spark.read.parquet(out).collect())
    assert dates == ["2023-11-14", "2024-01-30"]


def test_json_is_parsed_once_after_the_id_filter(spark):
    ok, _ = SM.split_valid(SM.parse_messages(_batch(spark), keep=("value",)))
    plan = ok._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
    # without the observe barrier Catalyst would push the filter below the
    # parse and evaluate from_json once per filtered field as well
    flat = SM.parse_messages(_batch(spark))
    pushed = flat.filter("userId is not null and movieId is not null")
    assert pushed._jdf.queryExecution().executedPlan().toString().count("from_json(") > 1


def test_min_partitions_spreads_a_single_partition_source(spark, tmp_path):
    src = str(tmp_path / "src")
    _write_json_lines(src, [m for m in MESSAGES if m is not None] * 5, "p.json")
    stream = SM.message_stream(spark, fmt="json", schema="value string", path=src, min_partitions=4)
    parsed = SM.parse_messages(stream).withColumn("part", F.spark_partition_id())
    out = str(tmp_path / "out")
    SM.run_available(
        SM.start_stream(parsed, path=out, checkpoint=str(tmp_path / "ck"), trigger={"availableNow": True})
    )
    back = spark.read.parquet(out)
    assert back.count() == 35 and back.select("part").distinct().count() == 4


def _epoch_stream(spark, src, tmp_path, ck="ck"):
    hook = SM.epoch_writer(
        str(tmp_path / "store"), str(tmp_path / "rejects"),
        lambda df: df.drop("value").withColumn("event_date", F.to_date("timestamp")),
    )
    parsed = SM.parse_messages(_stream_of(spark, src), keep=("value",))
    SM.run_available(SM.start_stream(parsed, foreach_batch=hook, checkpoint=str(tmp_path / ck), trigger={"availableNow": True}))


def test_every_message_reaches_exactly_one_table(spark, tmp_path):
    src = str(tmp_path / "src")
    _write_json_lines(src, MESSAGES, "p.json")
    _epoch_stream(spark, src, tmp_path)
    store, rejects = (spark.read.parquet(str(tmp_path / n)) for n in ("store", "rejects"))
    assert (store.count(), rejects.count()) == (4, 4)
    # a replayed micro-batch (its commit removed) overwrites its own folders
    for name in ("0", ".0.crc"):
        os.remove(tmp_path / "ck" / "commits" / name)
    _epoch_stream(spark, src, tmp_path)
    assert (spark.read.parquet(str(tmp_path / "store")).count(), spark.read.parquet(str(tmp_path / "rejects")).count()) == (4, 4)
    # the next micro-batch and another query add to them
    _write_json_lines(src, MESSAGES[:2], "q.json")
    _epoch_stream(spark, src, tmp_path)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 6
    _epoch_stream(spark, src, tmp_path, ck="other")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 12


def test_a_date_gets_few_files(spark, tmp_path):
    src = str(tmp_path / "src")
    for n in range(8):
        values = [json.dumps({"userId": 1, "movieId": n, "timestamp": 1700000000 + 86400 * day}) for day in range(5)]
        _write_json_lines(src, values, f"p{n}.json")
    _epoch_stream(spark, src, tmp_path)
    files = list((tmp_path / "store").rglob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 40 and len(files) == 5


def test_event_streams_read_files_and_folders_alike(spark, tmp_path):
    from ratelake.plans import streams as ST

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    a, b = (sorted(map(tuple, ST.q_stream_parse(spark, d).collect()), key=repr) for d in (SF_SMALL, str(tmp_path)))
    assert a == b and len(a) == events.count()


@pytest.mark.parametrize("offsets", ["latest", "earliest", None])
def test_starting_offsets_reach_the_source(spark, monkeypatch, offsets):
    given = {}
    reader = type(spark.readStream)
    monkeypatch.setattr(reader, "option", lambda self, k, v: (given.__setitem__(k, v), self)[1])
    monkeypatch.setattr(reader, "load", lambda self, *a: None)
    SM.message_stream(spark, "kafka", {"subscribe": "ratings"}, offsets, min_partitions=3)
    assert given == {"subscribe": "ratings", "minPartitions": "3"} | ({"startingOffsets": offsets} if offsets else {})


def test_the_console_gets_few_rows_of_a_whole_micro_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(0, 5000, 1, 3).select(F.to_json(F.struct(F.col("id").alias("userId"), F.col("id").alias("movieId"))).alias("value")).write.parquet(src)
    stream = SM.message_stream(spark, fmt="parquet", schema=spark.read.parquet(src).schema, path=src)
    query = SM.start_stream(SM.parse_messages(stream), sink="console", trigger={"availableNow": True}, options={"numRows": "1"})
    SM.run_available(query)
    seen = [p for p in query.recentProgress if p.numInputRows]
    assert sum(p.numInputRows for p in seen) == 5000
    assert 2 <= sum(p.sink.numOutputRows for p in seen) <= 2 * 3
    df = spark.range(0, 100, 1, 4)
    assert [r["id"] for r in SM.shown_rows(df, 2).collect()] == [0, 1, 25, 26, 50, 51, 75, 76]


def test_large_micro_batches_are_dealt_by_counts(spark, tmp_path):
    df = spark.range(0, 1000, 1, 3).withColumn("event_date", F.when(F.col("id") % 10 == 0, F.to_date(F.lit("2024-01-01"))))
    out = SM.dealt(df, ["event_date"], 100)
    assert out.columns == df.columns and sorted(r["id"] for r in out.collect()) == list(range(1000))
    tasks = [r.asDict() for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("event_date").alias("d")).collect()]
    assert len(tasks) == 10 and max(t["n"] for t in tasks) <= 150  # a null date of 900 rows takes nine of them
    dates = out.withColumn("p", F.spark_partition_id()).groupBy("event_date").agg(F.count_distinct("p").alias("files")).collect()
    assert {str(r["event_date"]): r["files"] for r in dates} == {"None": 9, "2024-01-01": 1}
    empty = SM.dealt(df.limit(0), ["event_date"], 100)
    assert empty.collect() == []


def test_the_epoch_writer_deals_large_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SM, "TASK_ROWS", 50)
    src, store, rejects = (str(tmp_path / n) for n in ("in", "store", "rejects"))
    body = F.struct(F.when(F.col("id") % 4 > 0, F.col("id")).alias("userId"), F.lit(1).alias("movieId"))
    spark.range(0, 400, 1, 1).select(F.to_json(body).alias("value")).write.parquet(src)
    stream = SM.message_stream(spark, fmt="parquet", schema=spark.read.parquet(src).schema, path=src)
    dated = lambda valid: valid.drop("value").withColumn("prediction", F.lit(1.5)).withColumn("event_date", F.to_date("timestamp"))
    hook = SM.epoch_writer(store, rejects, dated, panels=True)
    parsed = SM.parse_messages(stream, keep=("value",))
    SM.run_available(SM.start_stream(parsed, foreach_batch=hook, checkpoint=str(tmp_path / "ckpt"), trigger={"availableNow": True}))
    back = spark.read.parquet(store)
    assert sorted(r["userId"] for r in back.collect()) == [i for i in range(400) if i % 4]
    assert spark.read.parquet(rejects).count() == 100
    files = back.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) == 6 and max(r["count"] for r in files) <= 90  # one null date
