"""Column -> Column helpers. All are built-in expressions (JVM side, codegen)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelake.schemas import CSV_TIMESTAMP_FORMAT, GENRE_SEPARATOR


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def genre_array(col: str | Column, separator: str = GENRE_SEPARATOR) -> Column:
    """Split a separated genre string into an array (null stays null)."""
    return F.split(_c(col), re.escape(separator))


def parse_timestamp(col: str | Column, fmt: str | None = CSV_TIMESTAMP_FORMAT) -> Column:
    """Text -> timestamp; unparseable text gives null rather than failing the job."""
    if fmt is None:
        return F.try_to_timestamp(_c(col))
    return F.try_to_timestamp(_c(col), F.lit(fmt))


def rating_year(col: str | Column) -> Column:
    return F.year(_c(col)).cast("bigint")


def hour_of_day(col: str | Column) -> Column:
    return F.hour(_c(col)).cast("bigint")


def money2(col: str | Column) -> Column:
    """Display cast used by the top-rated report (half-up to 2 digits)."""
    return _c(col).cast("decimal(10,2)")


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two numeric arrays, accumulated in double.

    Null when either side is null (an unknown id), like a cold-start miss.
    """
    a, b = _c(a), _c(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def missing(col: str | Column) -> Column:
    """Null or NaN (the unscored test); NaN only exists for floating columns."""
    c = _c(col)
    return c.isNull() | F.isnan(c)


def nan_to_null(col: str | Column) -> Column:
    return F.nanvl(_c(col), F.lit(None).cast("double"))
