"""CSV landing with a reject table."""

from __future__ import annotations

from ratelake import schemas
from ratelake.sources import tables as TB


def _land(spark, tmp_path, text, **kwargs):
    (tmp_path / "r.csv").write_text(text)
    out, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    TB.land_csv(spark, str(tmp_path / "r.csv"), schemas.RATINGS, out, rejects, timestamp_format=schemas.CSV_TIMESTAMP_FORMAT, **kwargs)
    lines = sorted(r["line"] for r in spark.read.parquet(rejects).collect())
    return spark.read.parquet(out), lines


def test_every_line_is_kept_or_rejected_with_its_text(spark, tmp_path):
    good = [f"{i},{i + 1},3.5,2001-01-01 10:00:0{i}" for i in range(5)]
    bad = ["x,2,3.5,2001-01-01 10:00:00", "1,2,3.5", "1,2,3.5,2001-01-01 10:00:00,9", "1,2,high,2001-01-01 10:00:00", "1,2,3.5,soon", "9999999999,1,1.0,2001-01-01 10:00:00"]
    nulls = [",5,1.0,2001-01-01 10:00:00", "7,,,"]
    rows, lines = _land(spark, tmp_path, "\n".join(["userId,movieId,rating,timestamp", *good, *bad, *nulls]) + "\n")
    assert lines == sorted(bad) and rows.columns == schemas.RATINGS.names
    assert rows.count() == len(good) + len(nulls) and rows.where("userId = 7 AND rating IS NULL").count() == 1
    rows, lines = _land(spark, tmp_path, "\n".join(["userId,movieId,rating,timestamp", *good, *bad, *nulls]) + "\n", required=("userId", "movieId"))
    assert rows.count() == len(good) and len(lines) == len(bad) + 2 and "7,,," in lines


def test_a_file_without_lines(spark, tmp_path):
    rows, lines = _land(spark, tmp_path, "userId,movieId,rating,timestamp\n")
    assert rows.count() == 0 and lines == []
