from __future__ import annotations

from ratelake.operators import quality as Q

SCHEMA = "userId int, movieId int, rating float, note string"


def test_null_profile_one_pass(spark):
    df = spark.createDataFrame(
        [(1, None, 2.5, "a"), (None, None, 3.0, None), (3, 4, None, "c")], SCHEMA
    )
    got = {r["column_name"]: r["missing"] for r in Q.null_profile(df).collect()}
    assert got == {"userId": 1, "movieId": 2, "rating": 1, "note": 1}


def test_null_profile_odd_column_names(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "`it's` int, `a.b` int")
    got = {r["column_name"]: r["missing"] for r in Q.null_profile(df).collect()}
    assert got == {"it's": 1, "a.b": 1}


def test_null_profile_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = {r["column_name"]: r["missing"] for r in Q.null_profile(df).collect()}
    assert got == {"userId": 0, "movieId": 0, "rating": 0, "note": 0}


def test_duplicates_with_nulls_compare_equal(spark):
    df = spark.createDataFrame([(1, None, 2.5, None), (1, None, 2.5, None), (2, 3, 4.0, "x")], SCHEMA)
    s = Q.duplicate_summary(df).first()
    assert (s["total_rows"], s["unique_rows"], s["duplicate_rows"]) == (3, 2, 1)
    groups = Q.duplicate_groups(df).collect()
    assert len(groups) == 1 and groups[0]["n_copies"] == 2 and groups[0]["movieId"] is None
    assert Q.dedup(df).count() == 2
    assert Q.dedup(df, ["userId"]).count() == 2


def test_duplicate_summary_empty(spark):
    s = Q.duplicate_summary(spark.createDataFrame([], SCHEMA)).first()
    assert (s["total_rows"], s["unique_rows"], s["duplicate_rows"]) == (0, 0, 0)


def test_valid_ratings_bounds_inclusive_and_nulls_dropped(spark):
    df = spark.createDataFrame([(r,) for r in (0.4, 0.5, 5.0, 5.1, None)], "rating float")
    got = sorted(r["rating"] for r in Q.valid_ratings(df).collect())
    assert got == [0.5, 5.0]


def test_valid_ratings_float_column_one_decimal_bound(spark):
    # 0.7f widened to double is 0.699999988 < 0.7; the bound is cast to float first.
    df = spark.createDataFrame([(0.7,), (0.6,)], "rating float")
    kept = Q.valid_ratings(df, lo=0.7).collect()
    assert len(kept) == 1 and abs(kept[0]["rating"] - 0.7) < 1e-6


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 1.0, None), (2, None, 1.0, None), (2, None, 2.0, None)], SCHEMA)
    r = Q.distinct_count(df, "userId", "movieId").first()
    assert (r["n_distinct_userId"], r["n_distinct_movieId"]) == (2, 2)
    # distinct tuples include the one holding a null
    assert Q.distinct_rows(df, "userId", "movieId").first()["n_distinct"] == 3
    approx = Q.distinct_count(df, "userId", approx=True).first()
    assert approx["n_distinct_userId"] == 2


def test_count_by_and_row_counts(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 1.0, None), (2, 3, 1.0, None)], SCHEMA)
    got = {r["userId"]: r["n_rows"] for r in Q.count_by(df, "userId").collect()}
    assert got == {1: 2, 2: 1}
    counts = {r["table"]: r["n_rows"] for r in Q.row_counts({"a": df, "b": df.limit(0)}).collect()}
    assert counts == {"a": 3, "b": 0}
