"""Round-trip checks of the table sources and sinks.

Each run writes under a fresh folder in the shared scratch area (never a
machine-local temp folder) and returns what Spark reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.operators import enrich as E
from ratelake.plans import fixtures as FX
from ratelake.schemas import CSV_TIMESTAMP_FORMAT, MOVIES
from ratelake.session import scratch_path
from ratelake.sources import tables as TB

RATINGS_CSV_SCHEMA = T.StructType(
    [
        T.StructField("userId", T.LongType(), True),
        T.StructField("movieId", T.LongType(), True),
        T.StructField("rating", T.DoubleType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
    ]
)


def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Ratings -> CSV with header -> typed CSV scan."""
    path = scratch_path(spark, "csv")
    TB.write_csv(FX.ratings(spark, d), path, timestamp_format=CSV_TIMESTAMP_FORMAT)
    return TB.read_csv(spark, path, RATINGS_CSV_SCHEMA, timestamp_format=CSV_TIMESTAMP_FORMAT)


def q_parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Enriched table -> Parquet partitioned by year -> read back, counted per year."""
    path = scratch_path(spark, "parquet")
    enriched = E.build_enriched(FX.movies(spark, d), FX.ratings(spark, d), time_col="ts")
    TB.write_table(enriched, path, partition_by=["rating_year"], sort_within=["movieId"])
    back = TB.read_table(spark, path)
    return back.groupBy(F.col("rating_year").cast("bigint").alias("rating_year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("rating").alias("sum_rating")
    )


def q_csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Ratings -> CSV -> scan with inferred types, summed per year."""
    path = scratch_path(spark, "csv-inferred")
    TB.write_csv(FX.ratings(spark, d), path, timestamp_format=CSV_TIMESTAMP_FORMAT)
    back = TB.read_csv(spark, path, timestamp_format=CSV_TIMESTAMP_FORMAT)
    return back.groupBy(F.year("ts").cast("bigint").alias("rating_year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("userId") + F.col("movieId")).alias("sum_ids"), F.sum("rating").alias("sum_rating")
    )


def q_movies_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Items whose titles hold quotes, separators and genre bars -> CSV -> typed scan."""
    path = scratch_path(spark, "movies-csv")
    title = F.concat(F.lit('The "'), F.col("title"), F.lit('", part '), F.col("movieId").cast("string"), F.lit("; a|b"))
    TB.write_csv(FX.movies(spark, d).withColumn("title", title), path)
    return TB.read_csv(spark, path, MOVIES).withColumn("movieId", F.col("movieId").cast("bigint"))


def q_csv_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Events as rating lines of which some have a word for a rating, a field too few, a bad time or no user."""
    kind, parts = F.col("event_id") % 20, ["userId", "movieId", "prediction", "ts"]
    fields = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts}
    line = lambda **over: F.concat_ws(",", *[over.get(c, fields[c]) for c in parts if over.get(c, "") is not None])
    lines = FX.predictions(spark, d).select(
        F.when(kind == 0, line(prediction=F.lit("many")))
        .when(kind == 1, line(ts=None))
        .when(kind == 2, line(ts=F.lit("yesterday")))
        .when(kind == 3, line(userId=F.lit("")))
        .otherwise(line())
        .alias("value")
    )
    place = scratch_path(spark, "bad-csv")
    lines.write.text(f"{place}/in")
    schema = T.StructType([T.StructField(n, t, True) for n, t in zip(parts, (T.IntegerType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()), strict=True)])
    TB.land_csv(spark, f"{place}/in", schema, f"{place}/out", f"{place}/rejects", required=("userId",), header=False)
    good = spark.read.parquet(f"{place}/out").agg(F.lit("stored").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("userId").cast("bigint").alias("sum_user"))
    bad = spark.read.parquet(f"{place}/rejects")
    why = (
        F.when(F.col("line").contains("many"), "rating")
        .when(F.col("line").contains("yesterday"), "time")
        .when(F.col("line").startswith(","), "user")
        .otherwise("fields")
    )
    return good.unionByName(bad.groupBy(why.alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("sum_user")))
