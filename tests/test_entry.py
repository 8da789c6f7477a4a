"""The driver contract, and a few registered queries against DuckDB at sf0.001."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = "part orders lineitem events embeddings".split()


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["movieId", "title", "num_ratings", "avg_rating"]
    rows = df.collect()
    assert 0 < len(rows) <= 10


def test_every_query_of_the_library_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(E.QUERIES) <= set(o)


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
@pytest.mark.parametrize(
    "name",
    ["top_rated", "genre_stats", "rating_stats", "duplicate_summary", "dash_trends_24h", "dash_user_top_all",
     "factor_score", "null_profile", "dash_user_top_size", "csv_inferred", "movies_csv_roundtrip", "stream_decode",
     "stream_rejects", "stream_two_queries", "stream_score_sink", "store_trends_24h", "als_train_score", "stream_latest", "store_folded", "store_latest_10",
     "store_item_stats", "store_user_top", "csv_rejects"],
)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(d_cols, cur.fetchall())
