"""Duplicates of wide rows by digest: whole rows move only where a digest is met twice.

``operators.quality`` groups by whole rows, which shuffles every row that is not a copy on its
own task. Here a first pass counts 128-bit digests (two 64-bit hashes with different seeds, over
values and null flags), so 16 bytes a row are shuffled, whatever the width. Only rows whose digest is
repeated are then grouped by all their columns: equality is decided on values, so two rows
that share a digest by chance stay two.

The repeated digests are broadcast when they are counted as at most ``MAX_BROADCAST``. Beyond that so
many rows are copies that rows must meet anyway, and the plain grouping is used: it gives
the same rows, combining copies per task before its shuffle. Results equal those of ``quality``: nulls equal
each other, NaN equals NaN, and -0.0 equals 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.operators import quality as Q
from ratelake.session import ensure_checkpoint_dir

MAX_BROADCAST = 1_000_000  # digests of 16 bytes


def digest(columns: Sequence[str]) -> Column:
    """A 128-bit digest of these columns, as a struct of two longs.

    Hashes skip nulls, so null flags are hashed with the values: (1, null) differs from (null, 1).
    """
    cols = [Q._q(c) for c in columns]
    flags = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols]) if cols else F.lit("")
    return F.struct(F.xxhash64(F.lit(1), flags, *cols).alias("a"), F.xxhash64(F.lit(2), *cols, flags).alias("b"))


class _Split:
    """One pass over the digests: how many there are, and which are repeated."""

    def __init__(self, df: DataFrame, columns: Sequence[str], bound: int):
        self.df, self.columns = df, list(columns)
        ensure_checkpoint_dir(df.sparkSession)
        self.name = "digest"
        while self.name.lower() in {c.lower() for c in df.columns}:
            self.name += "_"
        counted = df.select(digest(self.columns).alias(self.name)).groupBy(self.name).agg(F.count(F.lit(1)).alias("copies"))
        # Kept: one row for each repeated digest, and one row in all for the others.
        repeated = F.col("copies") > 1
        kept = counted.groupBy(F.when(repeated, F.col(self.name)).alias(self.name)).agg(F.count(F.lit(1)).alias("digests"))
        kept = kept.checkpoint()
        self.single = kept.filter(F.col(self.name).isNull()).agg(F.coalesce(F.sum("digests"), F.lit(0)).alias("n"))
        self.repeated = kept.filter(F.col(self.name).isNotNull()).select(self.name)
        self.fits = self.repeated.count() <= bound

    def _rows(self, how: str) -> DataFrame:
        marked = self.df.withColumn(self.name, digest(self.columns))
        return marked.join(F.broadcast(self.repeated), self.name, how).select(*[Q._q(c) for c in self.df.columns])

    def candidates(self) -> DataFrame:
        return self._rows("left_semi") if self.fits else self.df

    def others(self) -> DataFrame:
        return self._rows("left_anti")


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None, bound: int = MAX_BROADCAST) -> DataFrame:
    """``total_rows, unique_rows, duplicate_rows``, as ``quality.duplicate_summary``."""
    split = _Split(df, columns or df.columns, bound)
    if not split.fits:
        return Q.duplicate_summary(df, columns)
    among = Q.duplicate_summary(split.candidates(), split.columns).select("total_rows", "unique_rows")
    alone = split.single.select(F.col("n").alias("total_rows"), F.col("n").alias("unique_rows"))
    both = among.unionByName(alone).agg(F.sum("total_rows").alias("total_rows"), F.sum("unique_rows").alias("unique_rows"))
    return both.withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_rows"))


def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None, bound: int = MAX_BROADCAST) -> DataFrame:
    """Every repeated row (or key) with its multiplicity ``n_copies`` (> 1)."""
    columns = list(columns or df.columns)
    return Q.duplicate_groups(_Split(df, columns, bound).candidates(), columns)


def dedup(df: DataFrame, bound: int = MAX_BROADCAST) -> DataFrame:
    """Whole-row de-duplication; rows of a digest met once are passed on without a shuffle."""
    split = _Split(df, df.columns, bound)
    if not split.fits:
        return Q.dedup(df)
    return split.others().unionAll(Q.dedup(split.candidates()))
