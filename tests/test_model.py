from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.operators import model as M
from ratelake.sources import tables as TB


@pytest.fixture(scope="module")
def planted(spark):
    """A rank-2 non-negative rating matrix, 40 users x 30 items, mostly observed."""
    rng = np.random.default_rng(7)
    u = rng.uniform(0.5, 1.5, size=(40, 2))
    v = rng.uniform(0.5, 1.5, size=(30, 2))
    rows = [
        (i, j, float(u[i] @ v[j]))
        for i in range(40)
        for j in range(30)
        if rng.random() < 0.85
    ]
    return spark.createDataFrame(rows, "userId int, movieId int, rating float")


@pytest.fixture(scope="module")
def fitted(planted):
    train, test = M.key_split(planted, F.col("userId") * 31 + F.col("movieId"))
    model = M.train(train, rank=2, max_iter=15, reg=0.001, seed=42)
    return model, train, test


def test_planted_low_rank_is_recovered(fitted):
    model, _, test = fitted
    scored = M.score(model, test)
    assert scored.count() > 0
    assert M.rmse(scored).first()["rmse"] < 0.05
    assert abs(M.rmse_value(scored) - M.rmse(scored).first()["rmse"]) < 1e-9


def test_score_factors_equals_model_transform(fitted):
    model, _, test = fitted
    uf, itf = M.model_factors(model)
    a = {(r["userId"], r["movieId"]): r["prediction"] for r in M.score(model, test).collect()}
    b = {
        (r["userId"], r["movieId"]): r["prediction"]
        for r in M.score_factors(test, uf, itf, cold_start="drop").collect()
    }
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-5 for k in a)


def test_save_and_load_give_same_scores(fitted, tmp_path):
    model, _, test = fitted
    path = TB.save_model(model, str(tmp_path / "als"))
    TB.save_model(model, path)  # overwrite works
    again = TB.load_model(path)
    a = sorted((r["userId"], r["movieId"], r["prediction"]) for r in M.score(model, test).collect())
    b = sorted((r["userId"], r["movieId"], r["prediction"]) for r in M.score(again, test).collect())
    assert a == b


def test_seeded_fit_repeats(planted):
    a = M.train(planted, rank=2, max_iter=3, seed=1).itemFactors.orderBy("id").collect()
    b = M.train(planted, rank=2, max_iter=3, seed=1).itemFactors.orderBy("id").collect()
    assert [r["features"] for r in a] == [r["features"] for r in b]


def test_config_b_cold_start_nan_then_drop(spark, planted):
    model = M.train(
        planted, rank=10, max_iter=10, reg=0.1, nonnegative=True, num_item_blocks=10, cold_start="nan", seed=3
    )
    unseen = spark.createDataFrame([(0, 0, 1.0), (999, 0, 1.0), (0, 999, 1.0)], "userId int, movieId int, rating float")
    scored = M.score(model, unseen)
    assert M.count_unscored(scored).first()["n_unscored"] == 2
    assert math.isnan(M.rmse(scored).first()["rmse"])
    clean = M.drop_unscored(scored)
    assert clean.count() == 1 and not math.isnan(M.rmse(clean).first()["rmse"])


def test_train_drops_null_ids(spark, planted):
    dirty = planted.union(spark.createDataFrame([(None, 1, 3.0), (1, None, 2.0)], planted.schema))
    model = M.train(dirty, rank=2, max_iter=2, seed=5)
    assert model.userFactors.count() == 40


def test_splits(planted):
    train, test = M.key_split(planted, F.col("userId") + F.col("movieId"))
    assert train.count() + test.count() == planted.count()
    sizes = {r["part"]: r["n_rows"] for r in M.split_sizes(planted, F.col("userId") + F.col("movieId")).collect()}
    assert sizes == {"train": train.count(), "test": test.count()}
    a, b = M.random_split(planted, 0.8, seed=42)
    assert a.count() + b.count() == planted.count() and a.count() > b.count()


def test_unknown_ids_score_null_with_factor_tables(spark):
    f = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.5])], "id int, features array<float>")
    df = spark.createDataFrame([(1, 2), (1, 3), (None, 2)], "userId int, movieId int")
    got = {(r["userId"], r["movieId"]): r["prediction"] for r in M.score_factors(df, f, f).collect()}
    assert got == {(1, 2): 1.5, (1, 3): None, (None, 2): None}
    assert M.score_factors(df, f, f, cold_start="drop").count() == 1


def test_factor_scorer_broadcasts_only_under_the_bound(fitted):
    model, _, test = fitted
    uf, itf = M.model_factors(model)
    small = M.factor_scorer(uf, itf)
    assert small.flags == {"broadcast_users": True, "broadcast_items": True}
    plan = small(test)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2
    assert M.factor_bytes(uf) == 40 * (2 * 4 + M.FACTOR_ROW_OVERHEAD)
    tight = M.factor_scorer(uf, itf, max_broadcast_bytes=0)
    assert tight.flags == {"broadcast_users": False, "broadcast_items": False}
    a = sorted((r["userId"], r["movieId"], round(r["prediction"], 9)) for r in small(test).collect())
    b = sorted((r["userId"], r["movieId"], round(r["prediction"], 9)) for r in tight(test).collect())
    assert a == b


def test_large_factor_tables_are_cached_and_joined_by_a_splittable_shuffle(spark, fitted):
    model, _, test = fitted
    uf, itf = M.model_factors(model)
    scorer = M.factor_scorer(uf, itf, max_broadcast_bytes=0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scorer(test)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        scorer.release()
    # both sides meet by a shuffle that adaptive execution may split
    assert plan.count("ENSURE_REQUIREMENTS") == 4 and "InMemoryTableScan" in plan


def test_batch_scoring_shuffles_no_rows_while_factors_are_small(spark):
    rows = spark.createDataFrame([(1, 2, 3.0), (2, 9, 1.0), (None, 1, 2.0)], "userId int, movieId int, rating double")
    f = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0])], "id int, features array<float>")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.score_measured(rows, f, f)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        large = M.score_measured(rows, f, f, max_broadcast_bytes=10)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
        for df in (got, large):
            assert sorted(map(str, df.select("rating", "prediction").collect())) == sorted(map(str, M.score_factors(rows, f, f).select("rating", "prediction").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
