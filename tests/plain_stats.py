"""The statistics as plain aggregates over the joined table: the brute-force side of the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATING, ITEM = "rating", "movieId"


def item_stats_enriched(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(ITEM, "title").agg(
        F.count(RATING).alias("num_ratings"), F.avg(RATING).alias("avg_rating")
    )


def rating_distribution_enriched(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(RATING).agg(F.count(F.lit(1)).alias("n_ratings")).orderBy(RATING)


def rating_stats_enriched(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.avg(RATING).alias("mean_rating"),
        F.stddev(RATING).alias("stddev_rating"),
        F.min(RATING).alias("min_rating"),
        F.max(RATING).alias("max_rating"),
    )


def yearly_stats_enriched(enriched: DataFrame) -> DataFrame:
    return (
        enriched.groupBy("rating_year")
        .agg(F.count(RATING).alias("n_ratings"), F.avg(RATING).alias("avg_rating"))
        .orderBy("rating_year")
    )


def genre_stats_enriched(enriched: DataFrame) -> DataFrame:
    return (
        enriched.select(F.explode("genres_array").alias("genre"), RATING)
        .groupBy("genre")
        .agg(F.count(RATING).alias("n_ratings"), F.avg(RATING).alias("avg_rating"))
        .orderBy(F.col("n_ratings").desc(), F.col("genre").asc())
    )
