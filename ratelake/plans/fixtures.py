"""Views that map the driver's tables onto the rating data model.

The driver ships TPC-H-like tables; these projections give them the shape of
the reference's inputs (see FIXTURES.md). They are plain DataFrame
expressions, so column pruning and filters above them reach the Parquet scans.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``userId, movieId, rating, ts``: one rating per line item of an order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "inner").select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"),
        F.col("o_orderdate").alias("ts"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``movieId, title, genres`` with genres separated by ``|``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.col("p_name").alias("title"),
        F.concat_ws("|", "p_type", "p_brand").alias("genres"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, userId, movieId, prediction, ts``: the prediction store."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("int").alias("movieId"),
        F.col("value").alias("prediction"),
        "ts",
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, features``: an id -> vector table standing in for ALS factors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features")
    )


# Fixed value: ISO layout with microseconds, so message times keep full precision.
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def messages_of(preds: DataFrame) -> DataFrame:
    """JSON message text (``value``) for each prediction row, as a producer sends it."""
    body = F.struct(
        "userId",
        "movieId",
        F.col("prediction").alias("rating"),
        F.col("ts").alias("timestamp"),
    )
    opts = {"timestampFormat": ISO_MICROS, "timestampNTZFormat": ISO_MICROS}
    return preds.select(F.to_json(body, opts).alias("value"))
