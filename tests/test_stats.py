from __future__ import annotations

import datetime as dt
import decimal
import math
import random
import statistics

import pytest

from ratelake.operators import enrich as E
from ratelake.operators import stats as S
from ratelake.sources import tables as TB
from ratelake import schemas
from tests import plain_stats as P

MOVIES = [
    (1, "Alpha", "A|B"),
    (2, "Beta", "(no genres listed)"),
    (3, "Gamma", ""),
    (4, "Delta", None),
    (5, "Epsilon", "B"),
]


def _ratings(spark, rows):
    return spark.createDataFrame(rows, schemas.RATINGS)


def _movies(spark, rows=MOVIES):
    return spark.createDataFrame(rows, schemas.MOVIES)


T0 = dt.datetime(2001, 5, 6, 7, 8, 9)


def test_genre_split_edge_cases(spark):
    ratings = _ratings(spark, [(1, m, 3.0, T0) for m in (1, 2, 3, 4)])
    got = {
        r["movieId"]: r["genres_array"]
        for r in E.build_enriched(_movies(spark), ratings).collect()
    }
    assert got == {1: ["A", "B"], 2: ["(no genres listed)"], 3: [""], 4: None}


def test_join_drops_unmatched_both_sides(spark):
    ratings = _ratings(spark, [(1, 1, 3.0, T0), (1, 99, 4.0, T0)])
    joined = E.join_items(_movies(spark), ratings)
    assert [r["movieId"] for r in joined.collect()] == [1]
    assert joined.columns[0] == "movieId" and joined.columns.count("movieId") == 1


def test_enrich_year_and_date(spark):
    ratings = _ratings(spark, [(1, 1, 3.0, T0)])
    r = E.build_enriched(_movies(spark), ratings).first()
    assert r["rating_year"] == 2001 and r["rating_date"] == T0


def test_parse_timestamp_bad_text_is_null(spark):
    df = spark.createDataFrame([("2001-05-06 07:08:09",), ("06/05/2001",), (None,)], "t string")
    got = [r["ts"] for r in E.parse_times(df, "t", "ts", schemas.CSV_TIMESTAMP_FORMAT).collect()]
    assert got == [T0, None, None]


def _random_case(seed: int):
    rnd = random.Random(seed)
    movies = list(MOVIES)
    # duplicated item ids: the join multiplies those ratings
    movies.append((5, "Epsilon", "B"))
    movies.append((1, "Alpha bis", "C|A"))
    rows = []
    for _ in range(rnd.randint(0, 60)):
        rating = None if rnd.random() < 0.1 else rnd.choice([0.5, 1.0, 2.5, 3.5, 4.0, 5.0])
        ts = dt.datetime(rnd.choice([1999, 2000, 2001]), 1, 1) if rnd.random() > 0.05 else None
        rows.append((rnd.randint(1, 5), rnd.randint(1, 7), rating, ts))
    return movies, rows


def _as_map(df, key, cols):
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in key)
        out[k] = tuple(r[c] for c in cols)
    return out


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            if isinstance(x, float) or isinstance(y, float):
                if x is None or y is None:
                    assert x is None and y is None, (k, a[k], b[k])
                else:
                    assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (k, a[k], b[k])
            else:
                assert x == y, (k, a[k], b[k])


@pytest.mark.parametrize("seed", range(6))
def test_pushed_down_aggregates_equal_join_then_aggregate(spark, seed):
    movie_rows, rating_rows = _random_case(seed)
    movies, ratings = _movies(spark, movie_rows), _ratings(spark, rating_rows)
    enriched = E.build_enriched(movies, ratings)

    _close(
        _as_map(S.item_stats(ratings, movies), ["movieId", "title"], ["num_ratings", "avg_rating"]),
        _as_map(P.item_stats_enriched(enriched), ["movieId", "title"], ["num_ratings", "avg_rating"]),
    )
    _close(
        _as_map(S.rating_distribution(ratings, movies), ["rating"], ["n_ratings"]),
        _as_map(P.rating_distribution_enriched(enriched), ["rating"], ["n_ratings"]),
    )
    _close(
        _as_map(S.yearly_stats(ratings, movies), ["rating_year"], ["n_ratings", "avg_rating"]),
        _as_map(P.yearly_stats_enriched(enriched), ["rating_year"], ["n_ratings", "avg_rating"]),
    )
    _close(
        _as_map(S.genre_stats(ratings, movies), ["genre"], ["n_ratings", "avg_rating"]),
        _as_map(P.genre_stats_enriched(enriched), ["genre"], ["n_ratings", "avg_rating"]),
    )
    cols = ["mean_rating", "stddev_rating", "min_rating", "max_rating"]
    a = S.rating_stats(ratings, movies).first()
    b = P.rating_stats_enriched(enriched).first()
    for c in cols:
        if b[c] is None or (isinstance(b[c], float) and math.isnan(b[c])):
            assert a[c] is None or math.isnan(a[c])
        else:
            assert math.isclose(a[c], b[c], rel_tol=1e-9, abs_tol=1e-9), c


def test_top_rated_orders_by_unrounded_mean_and_id(spark):
    stats = spark.createDataFrame(
        [(1, "a", 10, 2.675), (2, "b", 10, 2.6749), (3, "c", 10, 4.0), (4, "d", 10, 4.0), (5, "e", 9, 5.0)],
        "movieId int, title string, num_ratings long, avg_rating double",
    )
    got = S.top_rated(stats, min_count=10, k=3).collect()
    assert [r["movieId"] for r in got] == [3, 4, 1]
    assert got[2]["avg_rating"] == decimal.Decimal("2.68")  # half-up display cast


def test_catalogue_summary_is_macro_average(spark):
    stats = spark.createDataFrame(
        [(1, "a", 1, 5.0), (2, "b", 3, 1.0)], "movieId int, title string, num_ratings long, avg_rating double"
    )
    r = S.catalogue_summary(stats).first()
    assert (r["n_movies"], r["macro_avg_rating"], r["avg_ratings_per_movie"]) == (2, 3.0, 2.0)


def test_csv_with_schema_and_inferred(spark, tmp_path):
    path = str(tmp_path / "ratings_csv")
    df = _ratings(spark, [(1, 1, 3.5, T0), (2, 5, 1.0, None)])
    TB.write_csv(df, path, timestamp_format=schemas.CSV_TIMESTAMP_FORMAT)
    typed = TB.read_csv(spark, path, schemas.RATINGS, timestamp_format=schemas.CSV_TIMESTAMP_FORMAT)
    assert sorted(typed.collect()) == sorted(df.collect())
    inferred = TB.read_csv(spark, path)
    assert dict(inferred.dtypes)["userId"] == "int" and dict(inferred.dtypes)["rating"] == "double"
    assert inferred.count() == 2


def test_csv_permissive_bad_field_becomes_null(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("userId,movieId,rating,timestamp\n1,2,x,2001-05-06 07:08:09\n")
    row = TB.read_csv(spark, str(p), schemas.RATINGS, timestamp_format=schemas.CSV_TIMESTAMP_FORMAT).first()
    assert row["userId"] == 1 and row["rating"] is None


def test_parquet_write_partitioned_and_verify(spark, tmp_path):
    path = str(tmp_path / "enriched")
    ratings = _ratings(spark, [(1, 1, 3.0, T0), (2, 5, 4.0, dt.datetime(1999, 1, 1))])
    TB.write_table(E.build_enriched(_movies(spark), ratings), path, partition_by=["rating_year"], sort_within=["movieId"])
    assert TB.verify_table(spark, path).first()["n_rows"] == 2
    assert {r["rating_year"] for r in TB.read_table(spark, path).collect()} == {1999, 2001}


def test_deviation_of_few_and_of_large_values(spark):
    movies = _movies(spark)

    def stats(values):
        rows = spark.createDataFrame([(1, 1, float(v)) for v in values], "userId int, movieId int, rating double")
        return S.rating_stats(rows, movies).first(), rows

    assert tuple(stats([])[0]) == (None, None, None, None)
    assert tuple(stats([4.0])[0]) == (4.0, None, 4.0, 4.0)
    assert stats([3.0, 3.0, 3.0])[0]["stddev_rating"] == 0.0
    for values in ([1e8, 1e8 + 1, 1e8 + 2, 1e8 + 3], [1e8 + random.Random(i).random() for i in range(200)]):
        got, rows = stats(values)
        plain = P.rating_stats_enriched(rows).first()  # its own running mean is good to about 1e-8 here
        assert got["stddev_rating"] == pytest.approx(plain["stddev_rating"], rel=1e-8)
        assert got["stddev_rating"] == pytest.approx(statistics.stdev(values), rel=1e-12)
        assert got["mean_rating"] == pytest.approx(plain["mean_rating"], rel=1e-15)
    got, rows = stats([1e8, 1e8 + 1, 1e8 + 2, 1e8 + 3])
    assert got["stddev_rating"] == pytest.approx(P.rating_stats_enriched(rows).first()["stddev_rating"], rel=1e-9)


def test_bad_times_and_wide_ids_do_not_fail_a_job(spark):
    from ratelake.operators import model as M

    df = spark.createDataFrame([(1, "A", "not a time"), (1, "A", "2001-02-03 04:05:06")], "movieId int, genres string, timestamp string")
    assert [r["rating_year"] for r in E.enrich(df).collect()] == [None, 2001]
    wide = spark.createDataFrame([(i % 7, i % 5, 3.0) for i in range(35)] + [(3_000_000_000, 1, 3.0), (1, None, 3.0)],
                                 "userId long, movieId long, rating double")
    assert tuple(M.unusable_rows(wide).first()) == (37, 2)
    assert M.train(wide, rank=2, max_iter=1).userFactors.count() == 7
