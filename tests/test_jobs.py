"""The three programs end to end on tiny CSV inputs: prepare -> train -> stream -> dashboard."""

from __future__ import annotations

import datetime as dt
import json
import os

import numpy as np

from ratelake import jobs
from ratelake.streaming import messages as SM


def _write_inputs(tmp_path):
    rng = np.random.default_rng(11)
    movies = tmp_path / "movies.csv"
    movies.write_text(
        "movieId,title,genres\n"
        + "".join(f"{j},Film {j},{'Drama|Comedy' if j % 2 else 'Action'}\n" for j in range(30))
    )
    u, v = rng.uniform(0.6, 1.4, (40, 2)), rng.uniform(0.6, 1.4, (30, 2))
    lines = ["userId,movieId,rating,timestamp"]
    for i in range(40):
        for j in range(30):
            if rng.random() < 0.8:
                r = min(5.0, max(0.5, round(float(u[i] @ v[j]) * 2) / 2))
                lines.append(f"{i},{j},{r},{2000 + (i + j) % 3}-03-04 05:06:07")
    lines.append("1,2,9.5,2001-01-01 00:00:00")  # out of range: removed before the join
    lines.append("2,77,3.0,2001-01-01 00:00:00")  # unknown item: dropped by the join
    ratings = tmp_path / "ratings.csv"
    ratings.write_text("\n".join(lines) + "\n")
    return str(movies), str(ratings), len(lines) - 1


def test_programs_end_to_end(spark, tmp_path):
    movies, ratings, n_lines = _write_inputs(tmp_path)
    out = jobs.prepare_ratings(spark, movies, ratings, str(tmp_path / "enriched"))
    assert out["ratings_rows"].first()["n_rows"] == n_lines
    assert out["written"].first()["n_rows"] == n_lines - 2
    assert out["rating_stats"].first()["max_rating"] <= 5.0
    assert {r["genre"] for r in out["genres"].collect()} == {"Drama", "Comedy", "Action"}
    assert out["top_rated"].count() == 10

    model, err = jobs.train_model(spark, str(tmp_path / "enriched"), str(tmp_path / "model"), config="A")
    assert err.first()["rmse"] < 1.0
    _, err_b = jobs.train_model(spark, str(tmp_path / "enriched"), None, config="B")
    assert err_b.first()["rmse"] < 1.0

    src = tmp_path / "messages"
    src.mkdir()
    msgs = [
        {"userId": 1, "movieId": 2, "rating": 3.5, "timestamp": 1706608800},
        {"userId": 3, "movieId": 4, "rating": 4.0, "timestamp": "2024-01-30T09:00:00"},
        {"userId": 5, "movieId": 6, "rating": 1.0, "timestamp": "2024-01-28T09:00:00"},
    ]
    with open(src / "m.json", "w") as fh:
        for m in msgs:
            fh.write(json.dumps({"value": json.dumps(m)}) + "\n")
        fh.write(json.dumps({"value": "{broken"}) + "\n")
    queries = jobs.start_scoring(
        spark,
        str(tmp_path / "model"),
        str(tmp_path / "store"),
        str(tmp_path / "ck1"),
        str(tmp_path / "rejects"),
        source_format="json",
        source_options={"path": str(src)},
        starting_offsets=None,
        trigger={"availableNow": True},
        source_schema="value string",  # file sources need a schema; Kafka brings its own
    )
    for q in queries:
        SM.run_available(q)
    queries.release()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    rejects = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert [r["value"] for r in rejects] == ["{broken"]

    dash = jobs.dashboard(spark, str(tmp_path / "store"), as_of=dt.datetime(2024, 1, 30, 12, 0, 0))
    assert dash["stats"].first()["total_predictions"] == 3
    assert dash["summary"].first()["active_users_24h"] == 2
    assert sum(r["n_predictions"] for r in dash["activity"].collect()) == 2
    assert [r["userId"] for r in dash["recent"].collect()][:2] == [1, 3]
    assert os.path.isdir(tmp_path / "store" / "event_date=2024-01-30")
    latest = jobs.dashboard(spark, str(tmp_path / "store"), as_of="latest")
    assert latest["summary"].first()["active_users_24h"] == 2


def test_command_line_count_and_dashboard(spark, tmp_path, capsys):
    from ratelake.__main__ import main

    csv = tmp_path / "r.csv"
    csv.write_text("userId,movieId,rating,timestamp\n1,1,4.0,2001-01-01 10:00:00\n2,2,5.0,2002-01-01 10:00:00\n")
    store = tmp_path / "store"
    spark.createDataFrame(
        [(1, 2, 3.5, dt.datetime(2024, 1, 30, 10), dt.date(2024, 1, 30))],
        "userId int, movieId int, prediction float, timestamp timestamp, event_date date",
    ).write.partitionBy("event_date").parquet(str(store))
    # main() ends by stopping its session, which here is the shared test
    # session: record the call instead of stopping it.
    calls = []
    orig_stop = type(spark).stop
    type(spark).stop = lambda self: calls.append("stop")
    try:
        assert main(["count-csv", str(csv)]) == 0
        full = str(tmp_path / "full")
        args = ["--as-of", "2024-01-30T12:00:00", "--item", "2", "--user", "1", "--out", full]
        assert main(["dashboard", "--store", str(store), *args]) == 0
    finally:
        type(spark).stop = orig_stop
    out = capsys.readouterr().out
    assert "n_rows" in out and "== summary" in out and calls == ["stop", "stop"]
    read = lambda name: spark.read.parquet(os.path.join(full, name)).collect()
    assert read("user_top_size")[0]["n_items"] == 1 and read("item")[0]["count_ratings"] == 1
    assert [r["movieId"] for r in read("user_top")] == [2]


def test_full_results_are_written_past_the_preview(spark, tmp_path):
    rows = [(i % 7, i, i / 10, dt.datetime(2024, 1, 30, 10), dt.date(2024, 1, 30)) for i in range(100)]
    store = str(tmp_path / "store")
    schema = "userId int, movieId int, prediction float, timestamp timestamp, event_date date"
    spark.createDataFrame(rows, schema).write.partitionBy("event_date").parquet(store)
    from ratelake.__main__ import _deliver

    _deliver({"distribution": jobs.dashboard(spark, store)["distribution"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "distribution")).count() == 100


def test_dashboard_of_a_store_without_rows(spark, tmp_path):
    os.makedirs(tmp_path / "store")
    for as_of in (None, "latest"):
        dash = jobs.dashboard(spark, str(tmp_path / "store"), as_of=as_of, item_id=1, user_id=1)
        assert dash["summary"].first()["total_predictions"] == 0 and dash["stats"].first()["avg_prediction"] is None
        assert dash["trends"].count() == dash["recent"].count() == dash["user_top"].count() == 0


def test_blocks_follow_the_rows(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "ROWS_PER_BLOCK", 20)
    real = jobs.M.train
    monkeypatch.setattr(jobs.M, "train", lambda df, **k: (seen.append(k), real(df, **k))[1])
    rows = [(i % 20, i % 17, float(i % 5 + 1)) for i in range(340)]
    spark.createDataFrame(rows, "userId int, movieId int, rating float").write.parquet(str(tmp_path / "e"))
    jobs.train_model(spark, str(tmp_path / "e"))
    assert seen[0]["num_user_blocks"] == seen[0]["num_item_blocks"] > 10
