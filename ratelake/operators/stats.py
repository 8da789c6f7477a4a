"""Rating statistics over the enriched (movies x ratings) relation.

Two forms of each statistic:

* ``*_enriched(enriched)``: a plain aggregate over an already joined and
  materialised enriched table (the reference's clean Parquet table).
* the raw form ``f(ratings, movies)``: computes the same numbers straight from
  the two input tables, but aggregates the ratings *before* the join. The big
  side is reduced to one row per (item, group key) with map-side partial
  aggregation, so the join and the final shuffle only see the reduced rows.
  Catalyst does not push aggregates below joins by itself.

Inner-join semantics are kept exactly: ratings with no item are dropped, and
if an item id appears k times in the item table its ratings count k times,
because the pre-aggregated rows are joined to the item ids themselves
(``_item_ids``) and so repeat once per matching item row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import genre_array, money2, rating_year

ITEM = "movieId"
RATING = "rating"


def _item_ids(movies: DataFrame) -> DataFrame:
    """The item table's id column: one row per item row, duplicates kept."""
    return movies.select(ITEM)


def _ratio(num: str, den: str):
    # avg of no non-null ratings is null, never a division error.
    return F.try_divide(F.col(num), F.col(den))


# --------------------------------------------------------------------------- per item


def item_stats(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """``movieId, title, num_ratings, avg_rating`` per (movieId, title)."""
    per_item = ratings.groupBy(ITEM).agg(
        F.count(RATING).alias("c"), F.sum(F.col(RATING).cast("double")).alias("s")
    )
    joined = movies.select(ITEM, "title").join(per_item, ITEM, "inner")
    return (
        joined.groupBy(ITEM, "title")
        .agg(F.sum("c").alias("num_ratings"), F.sum("s").alias("s"))
        .select(ITEM, "title", "num_ratings", _ratio("s", "num_ratings").alias("avg_rating"))
    )



def catalogue_summary(stats: DataFrame) -> DataFrame:
    """Number of items, mean of per-item means (macro average), mean count per item.

    One aggregate instead of three actions over the per-item table.
    """
    return stats.agg(
        F.count(F.lit(1)).alias("n_movies"),
        F.avg("avg_rating").alias("macro_avg_rating"),
        F.avg("num_ratings").alias("avg_ratings_per_movie"),
    )


def top_rated(stats: DataFrame, min_count: int = 10, k: int = 10) -> DataFrame:
    """Best-rated items with at least ``min_count`` ratings.

    Ordered by the unrounded mean (ties by id); the mean is shown as
    decimal(10,2). ``orderBy().limit()`` plans as TakeOrderedAndProject: each
    task keeps its own top k, so no global sort happens.
    """
    return (
        stats.filter(F.col("num_ratings") >= min_count)
        .orderBy(F.col("avg_rating").desc(), F.col(ITEM).asc())
        .limit(k)
        .select(ITEM, "title", "num_ratings", money2("avg_rating").alias("avg_rating"))
    )


# --------------------------------------------------------------------------- global


def rating_distribution(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """``rating, n_ratings`` ordered by rating."""
    per_item = ratings.groupBy(ITEM, RATING).agg(F.count(F.lit(1)).alias("n"))
    joined = per_item.join(_item_ids(movies), ITEM, "inner")
    return joined.groupBy(RATING).agg(F.sum("n").alias("n_ratings")).orderBy(RATING)



def rating_stats(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """``mean_rating, stddev_rating`` (sample), ``min_rating, max_rating``.

    Ratings are pre-aggregated per (item, rating value), joined to the item ids
    (one copy per item row) and reduced to (value, weight) pairs. The pairs are
    centred on their mean before squaring, so values far from zero lose no
    digits. No rating or a single one has a null deviation.
    """
    dist = (
        ratings.filter(F.col(RATING).isNotNull())
        .groupBy(ITEM, RATING)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(_item_ids(movies), ITEM, "inner")
        .groupBy(F.col(RATING).cast("double").alias("r"))
        .agg(F.sum("n").alias("w"))
    )
    centre = dist.agg(F.try_divide(F.sum(F.col("w") * F.col("r")), F.sum("w")).alias("c")).scalar()
    moments = dist.withColumn("c", centre).agg(
        F.sum("w").alias("n"),
        F.max("c").alias("c"),
        F.sum(F.col("w") * (F.col("r") - F.col("c"))).alias("s"),
        F.sum(F.col("w") * (F.col("r") - F.col("c")) * (F.col("r") - F.col("c"))).alias("q"),
        F.min("r").alias("min_rating"),
        F.max("r").alias("max_rating"),
    )
    var = F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)
    return moments.select(
        (F.col("c") + F.col("s") / F.col("n")).alias("mean_rating"),
        F.sqrt(F.when(var.isNotNull(), F.greatest(var, F.lit(0.0)))).alias("stddev_rating"),
        "min_rating",
        "max_rating",
    )



def yearly_stats(ratings: DataFrame, movies: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """``rating_year, n_ratings, avg_rating`` ordered by year."""
    per_item = ratings.groupBy(ITEM, rating_year(F.col(time_col)).alias("rating_year")).agg(
        F.count(RATING).alias("c"), F.sum(F.col(RATING).cast("double")).alias("s")
    )
    joined = per_item.join(_item_ids(movies), ITEM, "inner")
    return (
        joined.groupBy("rating_year")
        .agg(F.sum("c").alias("n_ratings"), F.sum("s").alias("s"))
        .select("rating_year", "n_ratings", _ratio("s", "n_ratings").alias("avg_rating"))
        .orderBy("rating_year")
    )



def genre_stats(ratings: DataFrame, movies: DataFrame, genres: str = "genres") -> DataFrame:
    """``genre, n_ratings, avg_rating``; a rating counts once in each of its genres.

    Only the item table is exploded (one row per item and genre); the ratings
    arrive pre-aggregated per item.
    """
    per_item = ratings.groupBy(ITEM).agg(
        F.count(RATING).alias("c"), F.sum(F.col(RATING).cast("double")).alias("s")
    )
    item_genres = movies.select(ITEM, F.explode(genre_array(genres)).alias("genre"))
    joined = item_genres.join(per_item, ITEM, "inner")
    return (
        joined.groupBy("genre")
        .agg(F.sum("c").alias("n_ratings"), F.sum("s").alias("s"))
        .select("genre", "n_ratings", _ratio("s", "n_ratings").alias("avg_rating"))
        .orderBy(F.col("n_ratings").desc(), F.col("genre").asc())
    )
