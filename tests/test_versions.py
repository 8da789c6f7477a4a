"""Versioned models, trigger records and timed streams."""

from __future__ import annotations

import pytest

from ratelake.operators import model as M
from ratelake.operators import versions as V
from ratelake.sources import files as FS
from ratelake.streaming import messages as SM
from ratelake.streaming import progress as PR


def _factors(spark, scale):
    return spark.createDataFrame([(1, [1.0 * scale, 2.0]), (2, [0.5, scale / 2])], "id int, features array<float>")


def test_versions_switch_at_once_and_failed_writes_change_nothing(spark, tmp_path):
    root, rows = str(tmp_path / "models"), spark.createDataFrame([(1, 2), (2, 1), (9, 1)], "userId int, movieId int")
    scorer = V.CurrentScorer(spark, root)
    assert V.current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        scorer(rows)
    one, two = _factors(spark, 1), _factors(spark, 3)
    assert V.publish_factors(one, one, root) == 1
    got = lambda: sorted(map(tuple, scorer(rows).select("userId", "model_version", "prediction").collect()), key=str)
    want = lambda f, v: sorted(((r.userId, v, r.prediction) for r in M.score_factors(rows, f, f, cold_start="nan").collect()), key=str)
    assert got() == want(one, 1)
    two.write.parquet(f"{root}/version=000002/userFactors")  # a writer that died half way
    assert got() == want(one, 1)
    assert V.publish_factors(two, two, root) == 3 and got() == want(two, 3)
    V.publish_factors(one, one, root)
    assert V.remove_versions(spark, root, keep=1) == 3 and V.current_version(spark, root) == 4 and got() == want(one, 4)
    scorer.release()


def test_a_published_model_loads_again(spark, tmp_path):
    rows = spark.createDataFrame([(i % 6, i % 5, float(i % 4 + 1)) for i in range(60)], "userId int, movieId int, rating float")
    model, root = M.train(rows, rank=2, max_iter=2, reg=0.1, seed=1), str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        V.load_version(spark, root)
    assert V.publish_model(spark, model, root) == 1 and V.publish_model(spark, model, root) == 2
    back = V.load_version(spark, root, 1)
    score = lambda m: sorted(map(tuple, m.transform(rows).collect()))
    assert score(back) == score(model)
    user, item = V.factors(spark, root, 2)
    assert (user.count(), item.count()) == (6, 5)


def test_of_two_writers_one_wins(spark, tmp_path):
    FS.write_json(spark, f"{tmp_path}/a.json", {"n": 1})
    with pytest.raises(FS.FileConflict):
        FS.write_json(spark, f"{tmp_path}/a.json", {"n": 2})
    assert FS.read_json(spark, f"{tmp_path}/a.json") == {"n": 1}
    FS.write_json(spark, f"{tmp_path}/a.json", {"n": 3}, replace=True)
    assert FS.read_json(spark, f"{tmp_path}/a.json") == {"n": 3}
    assert [p.rsplit("/", 1)[1] for p in FS.matching(spark, f"{tmp_path}/*.json")] == ["a.json"]


def test_trigger_log_keeps_the_newest_records(spark, tmp_path):
    src = tmp_path / "src"
    log = PR.watch(spark, interval_ms=1, keep=2)
    try:
        for n in range(3):
            spark.createDataFrame([(f"{n}-{i}",) for i in range(n + 1)], "value string").coalesce(1).write.mode("append").json(str(src))
        stream = SM.message_stream(spark, fmt="json", schema="value string", path=str(src), options={"maxFilesPerTrigger": "1"})
        query = SM.start_stream(stream, path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"), trigger={"availableNow": True})
        SM.run_available(query)
        log.wait_ended(query)
    finally:
        PR.unwatch(spark, log)
    records = log.of(query)
    assert [r["batch_id"] for r in records] == [1, 2] and log.summary(query)["batches"] == 2
    assert all(r["late"] and r["interval_ms"] > 0 for r in records) and log.ended[str(query.id)] is None
    assert log.as_table(spark, query).count() == 2 and log.of("unknown") == []
