"""Join of items and ratings, and the derived columns of the enriched table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.functions.columns import genre_array, parse_timestamp, rating_year
from ratelake.schemas import CSV_TIMESTAMP_FORMAT


def join_items(movies: DataFrame, ratings: DataFrame, key: str = "movieId") -> DataFrame:
    """Inner equi-join on the item id (USING form: one key column).

    No broadcast hint: the item table grows with the catalogue. Catalyst
    broadcasts it only when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold``, and AQE re-decides from the real
    shuffle sizes (and splits a skewed hot item) at run time.
    """
    return movies.join(ratings, key, "inner")


def enrich(df: DataFrame, genres: str = "genres", time_col: str = "timestamp") -> DataFrame:
    """Add ``genres_array``, ``rating_date`` and ``rating_year``: narrow, no shuffle.

    A time column that is already a timestamp (with or without zone) is kept
    as it is; text is converted with ``try_to_timestamp`` (bad text becomes null).
    """
    dtype = df.schema[time_col].dataType
    is_ts = isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    ts = F.col(time_col) if is_ts else F.try_to_timestamp(F.col(time_col))
    return df.withColumns(
        {
            "genres_array": genre_array(genres),
            "rating_date": ts,
            "rating_year": rating_year(ts),
        }
    )


def parse_times(
    df: DataFrame,
    text_col: str,
    out_col: str,
    fmt: str | None = CSV_TIMESTAMP_FORMAT,
    wall_clock: bool = False,
) -> DataFrame:
    """Parse a text timestamp column (``fmt=None``: ISO forms); bad text becomes null, not an error.

    ``wall_clock=True`` returns ``timestamp_ntz`` (the text's local time, no
    zone), the type of zone-less source tables.
    """
    parsed = parse_timestamp(text_col, fmt)
    return df.withColumn(out_col, parsed.cast("timestamp_ntz") if wall_clock else parsed)


def build_enriched(movies: DataFrame, ratings: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """Movies x ratings with the enriched columns (the reference's clean table)."""
    return enrich(join_items(movies, ratings), time_col=time_col)
