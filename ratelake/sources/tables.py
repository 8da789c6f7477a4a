"""Batch table sources and sinks: CSV, Parquet, model directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    header: bool = True,
    mode: str = "PERMISSIVE",
    timestamp_format: str | None = None,
) -> DataFrame:
    """CSV scan with a header row.

    With a schema the scan is typed up front (no extra inference pass over the
    data); without one Spark samples the files to infer types, which costs an
    extra full read and should stay off large inputs.
    """
    reader = spark.read.option("header", header).option("mode", mode)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


CORRUPT = "_corrupt_record"


def land_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    out: str,
    rejects: str,
    timestamp_format: str | None = None,
    required: Sequence[str] = (),
    header: bool = True,
) -> None:
    """CSV -> Parquet table ``out``; lines that do not fit the schema go to ``rejects`` as they were (``line``).

    A plain PERMISSIVE scan turns a bad field into a null without a trace. Here the reader keeps
    the raw text of a line with a bad field or a wrong number of fields; a line that lacks a
    ``required`` value is rejected too. The text is parsed once, with all columns (a pruned scan would not look at
    the others), into a Parquet copy that both tables are taken from; the copy is removed at the end.
    """
    from pyspark.sql import functions as F

    from ratelake.session import remove_scratch, scratch_path

    reader = spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    staged = scratch_path(spark, "land")
    reader.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])).csv(path).write.parquet(staged)
    rows = spark.read.parquet(staged)
    bad = F.col(CORRUPT).isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    names = [c for c in rows.columns if c != CORRUPT]
    rows.where(~bad).select(*names).write.mode("overwrite").parquet(out)
    # A whole line that only lacks a required value has no raw text: it is put together again.
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))
    rows.where(bad).select(line.alias("line")).write.mode("overwrite").parquet(rejects)
    remove_scratch(spark, staged)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; filters and projections above it reach the file reader."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    fmt: str = "parquet",
    sort_within: Sequence[str] | None = None,
) -> str:
    """Write a table; partitioning by a date/year column enables pruning later.

    For a partitioned write the rows are first rebalanced on the partition
    columns (AQE ``REBALANCE``): each output directory is written by a few
    tasks sized to the advisory partition size, instead of every upstream task
    leaving a small file in every directory; a hot partition value is split
    across several tasks rather than landing on one.

    ``sort_within`` sorts each task's rows (no shuffle) so that Parquet's
    per-row-group min/max statistics on those columns let later filters skip
    row groups.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_within:
        df = df.sortWithinPartitions(*(list(partition_by or []) + list(sort_within)))
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", timestamp_format: str | None = None) -> str:
    writer = df.write.mode(mode).option("header", True)
    if timestamp_format:
        writer = writer.option("timestampFormat", timestamp_format)
    writer.csv(path)
    return path


def verify_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a written table back and count it (one row, ``n_rows``)."""
    from pyspark.sql import functions as F

    return read_table(spark, path).agg(F.count(F.lit(1)).alias("n_rows"))


def load_model(path: str) -> ALSModel:
    return ALSModel.load(path)


def save_model(model: ALSModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path
