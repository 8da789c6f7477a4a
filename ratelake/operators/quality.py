"""Profiling and cleaning: counts, missing values, duplicates, ranges, dedup.

Every profile is one aggregation job. The reference ran one job per column for
missing values and separate jobs for totals and distincts; here each question
is a single scan with partial (map-side) aggregation, so a hot key or a hot
duplicate group collapses to one row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(name: str):
    """A column by its exact name (dots and quotes are not parsed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_count(df: DataFrame, name: str | None = None) -> DataFrame:
    """One row: ``n_rows`` (plus ``table`` when a name is given)."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if name is not None:
        out = out.select(F.lit(name).alias("table"), "n_rows")
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n_rows`` for several tables (a union of single-row aggregates)."""
    parts = [row_count(df, name) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, missing``: nulls per column in one pass, then unpivoted."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(_q(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], [_q(c) for c in columns], "column_name", "missing")


def _group_counts(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    cols = list(columns or df.columns)
    # groupBy treats nulls as equal keys, like distinct()/dropDuplicates().
    return df.groupBy(*[_q(c) for c in cols]).agg(F.count(F.lit(1)).alias("n_copies"))


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``total_rows, unique_rows, duplicate_rows`` from one grouped pass."""
    grouped = _group_counts(df, columns)
    return grouped.agg(
        F.coalesce(F.sum("n_copies"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_rows"))


def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every repeated row (or key) with its multiplicity ``n_copies`` (> 1)."""
    return _group_counts(df, columns).filter(F.col("n_copies") > 1)


def dedup(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Whole-row (or subset) de-duplication."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def distinct_count(df: DataFrame, *columns: str, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """Distinct count of each named column, one row, ``n_distinct_<col>``.

    Exact counting de-duplicates on the key (a shuffle of distinct keys, after
    map-side de-duplication); ``approx=True`` uses HyperLogLog++ sketches,
    which merge in constant memory and is the right choice for very wide keys.
    """
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.agg(*[fn(_q(c)).alias(f"n_distinct_{c}") for c in columns])


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Number of distinct tuples over ``columns`` (null-containing tuples count)."""
    return df.select(*[_q(c) for c in columns]).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def count_by(df: DataFrame, column: str, name: str = "n_rows") -> DataFrame:
    """Rows per key."""
    return df.groupBy(_q(column)).agg(F.count(F.lit(1)).alias(name))


def valid_ratings(df: DataFrame, lo: float = 0.5, hi: float = 5.0, column: str = "rating") -> DataFrame:
    """Inclusive range filter; nulls are dropped.

    The bounds are cast to the column's own type so that a float column is not
    compared against a wider double literal (0.7f >= 0.7 is false in double).
    """
    dtype = df.schema[column].dataType
    c = F.col(column)
    return df.filter(c.between(F.lit(lo).cast(dtype), F.lit(hi).cast(dtype)))
