"""DuckDB SQL for each registered query, over the driver's pre-registered views.

The fixture views are repeated here as CTEs in DuckDB's dialect
(``json_extract_string`` for Spark's ``get_json_object``, ``string_split``
for ``split``, ``try_strptime`` for ``try_to_timestamp``).
"""

from __future__ import annotations

from ratelake.plans.registry import (
    DASH_ITEM,
    DASH_MIN_COUNT,
    DASH_MIN_COUNT_STRICT,
    DASH_USER,
    RANGE_HI,
    RANGE_LO,
    TOP_MIN_COUNT,
    TOP_MIN_COUNT_STRICT,
)

RATINGS = (
    "ratings AS (SELECT o_custkey AS userId, l_partkey AS movieId, "
    "ceil(l_quantity / 5) / 2 AS rating, o_orderdate AS ts "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
)
MOVIES = (
    "movies AS (SELECT p_partkey AS movieId, p_name AS title, "
    "concat_ws('|', p_type, p_brand) AS genres FROM part)"
)
PREDS = (
    "preds AS (SELECT event_id, user_id AS userId, "
    "CAST(json_extract_string(props, '$.k') AS INTEGER) AS movieId, "
    "value AS prediction, ts FROM events)"
)
FACTORS = "factors AS (SELECT vec_id AS id, embedding AS features FROM embeddings)"
ITEM_STATS = (
    "item_stats AS (SELECT m.movieId, m.title, count(r.rating) AS num_ratings, "
    "avg(r.rating) AS avg_rating FROM movies m JOIN ratings r ON m.movieId = r.movieId "
    "GROUP BY m.movieId, m.title)"
)
ENRICHED = (
    "enriched AS (SELECT m.movieId, m.title, m.genres, r.userId, r.rating, r.ts, "
    "string_split(m.genres, '|') AS genres_array, r.ts AS rating_date, "
    "CAST(year(r.ts) AS BIGINT) AS rating_year "
    "FROM movies m JOIN ratings r ON m.movieId = r.movieId)"
)
AS_OF = "(SELECT max(ts) FROM preds) - INTERVAL 24 HOURS"


# The scored messages as the stream stores them.
STORED = (
    "stored AS (SELECT m.*, list_dot_product(CAST(u.features AS DOUBLE[]), CAST(i.features AS DOUBLE[])) AS prediction, "
    "CAST(m.\"timestamp\" AS DATE) AS event_date FROM msgs m "
    "LEFT JOIN factors u ON m.userId = u.id LEFT JOIN factors i ON m.movieId = i.id)"
)


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _top_rated(min_count: int) -> str:
    return _with(RATINGS, MOVIES, ITEM_STATS) + (
        "SELECT movieId, title, num_ratings, CAST(avg_rating AS DECIMAL(10,2)) AS avg_rating "
        f"FROM (SELECT * FROM item_stats WHERE num_ratings >= {min_count} "
        "ORDER BY avg_rating DESC, movieId ASC LIMIT 10) t"
    )


def _dash_top(min_count: int) -> str:
    return _with(PREDS) + (
        "SELECT movieId, round(avg(prediction), 6) AS average_rating, count(*) AS total_ratings "
        f"FROM preds GROUP BY movieId HAVING count(*) >= {min_count} "
        "ORDER BY CASE WHEN isnan(avg(prediction)) THEN NULL ELSE avg(prediction) END DESC NULLS LAST, "
        "movieId LIMIT 10"
    )


def _latest(k: int) -> str:
    return _with(PREDS) + f"SELECT * FROM preds ORDER BY ts DESC, event_id DESC LIMIT {k}"


_LINEITEM_COLS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


def _null_profile() -> str:
    li = (
        "li AS (SELECT * REPLACE (nullif(l_returnflag, 'N') AS l_returnflag) FROM lineitem)"
    )
    counts = ", ".join(
        f"count(*) FILTER (WHERE {c} IS NULL) AS m{i}" for i, c in enumerate(_LINEITEM_COLS)
    )
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, m{i} AS missing FROM agg" for i, c in enumerate(_LINEITEM_COLS)
    )
    return _with(li, f"agg AS (SELECT {counts} FROM li)") + rows


SCORED = (
    "scored AS (SELECT r.*, list_dot_product(CAST(u.features AS DOUBLE[]), "
    "CAST(i.features AS DOUBLE[])) AS prediction FROM ratings r "
    "LEFT JOIN factors u ON r.userId = u.id LEFT JOIN factors i ON r.movieId = i.id)"
)

MESSAGES = (
    "msgs AS (SELECT CAST(userId AS INTEGER) AS userId, movieId, "
    "CAST(prediction AS FLOAT) AS rating, ts AS \"timestamp\" FROM preds)"
)

ORACLE: dict[str, str] = {
    "top_rated": _top_rated(TOP_MIN_COUNT),
    "top_rated_min25": _top_rated(TOP_MIN_COUNT_STRICT),
    "item_stats": _with(RATINGS, MOVIES, ITEM_STATS)
    + "SELECT movieId, title, num_ratings, round(avg_rating, 6) AS avg_rating FROM item_stats",
    "catalogue_summary": _with(RATINGS, MOVIES, ITEM_STATS)
    + "SELECT count(*) AS n_movies, round(avg(avg_rating), 6) AS macro_avg_rating, "
    "round(avg(num_ratings), 6) AS avg_ratings_per_movie FROM item_stats",
    "join_items": _with(RATINGS, MOVIES)
    + "SELECT m.movieId, m.title, m.genres, r.userId, r.rating, r.ts "
    "FROM movies m JOIN ratings r ON m.movieId = r.movieId",
    "enrich": _with(RATINGS, MOVIES, ENRICHED)
    + "SELECT movieId, userId, rating, genres_array, rating_date, rating_year FROM enriched",
    "parse_timestamp": "WITH raw AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' "
    "THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END "
    "AS ts_text FROM orders) SELECT o_orderkey, ts_text, "
    "try_strptime(ts_text, '%Y-%m-%d %H:%M:%S') AS parsed_ts FROM raw",
    "rating_distribution": _with(RATINGS, MOVIES, ENRICHED)
    + "SELECT rating, count(*) AS n_ratings FROM enriched GROUP BY rating ORDER BY rating",
    "rating_stats": _with(RATINGS, MOVIES, ENRICHED)
    + "SELECT round(avg(rating), 6) AS mean_rating, round(stddev_samp(rating), 6) AS stddev_rating, "
    "min(rating) AS min_rating, max(rating) AS max_rating FROM enriched",
    "yearly_stats": _with(RATINGS, MOVIES, ENRICHED)
    + "SELECT rating_year, count(rating) AS n_ratings, round(avg(rating), 6) AS avg_rating "
    "FROM enriched GROUP BY rating_year ORDER BY rating_year",
    "genre_stats": _with(RATINGS, MOVIES, ENRICHED)
    + "SELECT genre, count(rating) AS n_ratings, round(avg(rating), 6) AS avg_rating FROM "
    "(SELECT unnest(genres_array) AS genre, rating FROM enriched) g "
    "GROUP BY genre ORDER BY n_ratings DESC, genre",
    "row_counts": _with(RATINGS, MOVIES)
    + "SELECT 'ratings' AS \"table\", count(*) AS n_rows FROM ratings "
    "UNION ALL SELECT 'movies' AS \"table\", count(*) AS n_rows FROM movies",
    "null_profile": _null_profile(),
    "duplicate_summary": _with(RATINGS)
    + "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, "
    "CAST(sum(n) AS BIGINT) - count(*) AS duplicate_rows FROM "
    "(SELECT count(*) AS n FROM ratings GROUP BY userId, movieId, rating, ts) g",
    "duplicate_groups": _with(RATINGS)
    + "SELECT userId, movieId, rating, ts, count(*) AS n_copies FROM ratings "
    "GROUP BY userId, movieId, rating, ts HAVING count(*) > 1",
    "dedup": _with(RATINGS) + "SELECT DISTINCT * FROM ratings",
    "distinct_keys": _with(RATINGS)
    + "SELECT count(DISTINCT userId) AS n_distinct_userId, count(DISTINCT movieId) AS n_distinct_movieId "
    "FROM ratings",
    "distinct_pairs": _with(RATINGS)
    + "SELECT count(*) AS n_distinct FROM (SELECT DISTINCT userId, movieId FROM ratings) t",
    "ratings_per_user": _with(RATINGS)
    + "SELECT userId, count(*) AS n_ratings FROM ratings GROUP BY userId",
    "rating_range": _with(RATINGS)
    + f"SELECT * FROM ratings WHERE rating BETWEEN {RANGE_LO} AND {RANGE_HI}",
    "dash_stats": _with(PREDS)
    + "SELECT count(*) AS total_predictions, round(avg(prediction), 2) AS avg_prediction, "
    "count(DISTINCT userId) AS unique_users FROM preds",
    "dash_item_stats": _with(PREDS)
    + f"SELECT CAST({DASH_ITEM} AS BIGINT) AS movieId, round(avg(prediction), 6) AS avg_rating, "
    "count(*) AS count_ratings, max(prediction) AS max_rating, min(prediction) AS min_rating "
    f"FROM preds WHERE movieId = {DASH_ITEM} HAVING count(*) > 0",
    "dash_top_items": _dash_top(DASH_MIN_COUNT),
    "dash_top_items_min95": _dash_top(DASH_MIN_COUNT_STRICT),
    "dash_activity_24h": _with(PREDS)
    + "SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n_predictions FROM preds "
    f"WHERE ts >= {AS_OF} GROUP BY 1 ORDER BY 1",
    "dash_trends_24h": _with(PREDS)
    + "SELECT CAST(hour(ts) AS BIGINT) AS hour, round(avg(prediction), 6) AS avg_rating, "
    f"count(*) AS n_predictions FROM preds WHERE ts >= {AS_OF} GROUP BY 1 ORDER BY 1",
    "dash_summary": _with(PREDS)
    + "SELECT count(*) AS total_predictions, "
    f"count(DISTINCT CASE WHEN ts >= {AS_OF} THEN userId END) AS active_users_24h, "
    "round(avg(prediction), 6) AS avg_rating FROM preds",
    "dash_recent_5": _latest(5),
    "dash_latest_10": _latest(10),
    "dash_latest_named": _with(PREDS)
    + "SELECT userId, movieId, prediction, ts FROM preds ORDER BY ts DESC, event_id DESC LIMIT 10",
    "dash_distribution": _with(PREDS)
    + "SELECT prediction, count(*) AS n_predictions FROM preds "
    "WHERE prediction IS NOT NULL AND NOT isnan(prediction) GROUP BY prediction ORDER BY prediction",
    "dash_user_top": _with(PREDS)
    + f"SELECT event_id, movieId, prediction FROM preds WHERE userId = {DASH_USER} "
    "ORDER BY CASE WHEN isnan(prediction) THEN NULL ELSE prediction END DESC NULLS LAST, "
    "event_id LIMIT 5",
    "dash_user_top_all": _with(PREDS)
    + "SELECT userId, rank, event_id, movieId, prediction FROM (SELECT *, row_number() OVER "
    "(PARTITION BY userId ORDER BY CASE WHEN isnan(prediction) THEN NULL ELSE prediction END "
    "DESC NULLS LAST, event_id) AS rank FROM preds) t WHERE rank <= 5",
    "csv_roundtrip": _with(RATINGS) + "SELECT * FROM ratings",
    "parquet_roundtrip": _with(RATINGS, MOVIES, ENRICHED)
    + "SELECT rating_year, count(*) AS n_rows, sum(rating) AS sum_rating FROM enriched "
    "GROUP BY rating_year",
    "split_sizes": _with(RATINGS)
    + "SELECT CASE WHEN ((userId + movieId) % 10 + 10) % 10 < 8 THEN 'train' ELSE 'test' END AS part, "
    "count(*) AS n_rows FROM ratings GROUP BY 1",
    "factor_score": _with(RATINGS, FACTORS, SCORED)
    + "SELECT userId, movieId, rating, ts, round(prediction, 6) AS prediction FROM scored",
    "unscored_count": _with(RATINGS, FACTORS, SCORED)
    + "SELECT count(*) FILTER (WHERE prediction IS NULL OR isnan(prediction)) AS n_unscored FROM scored",
    "scored_only": _with(RATINGS, FACTORS, SCORED)
    + "SELECT userId, movieId, rating, ts, round(prediction, 6) AS prediction FROM scored "
    "WHERE prediction IS NOT NULL AND NOT isnan(prediction)",
    "factor_rmse": _with(RATINGS, FACTORS, SCORED)
    + "SELECT round(sqrt(avg(power(rating - prediction, 2))), 6) AS rmse FROM scored "
    "WHERE prediction IS NOT NULL AND NOT isnan(prediction)",
    "als_cold_start": _with(RATINGS)
    + ", parts AS (SELECT *, ((userId + movieId) % 10 + 10) % 10 < 8 AS is_train FROM ratings), "
    "tr_users AS (SELECT DISTINCT userId FROM parts WHERE is_train), "
    "tr_items AS (SELECT DISTINCT movieId FROM parts WHERE is_train) "
    "SELECT count(*) AS n_test, count(*) FILTER (WHERE u.userId IS NULL OR i.movieId IS NULL) AS n_unscored "
    "FROM parts t LEFT JOIN tr_users u ON t.userId = u.userId LEFT JOIN tr_items i ON t.movieId = i.movieId "
    "WHERE NOT t.is_train",
    "rmse": _with(RATINGS)
    + "SELECT round(sqrt(avg(power(rating - (2.75 + (movieId % 5 - 2) * 0.1), 2))), 6) AS rmse "
    "FROM ratings",
    "stream_parse": _with(PREDS, MESSAGES) + "SELECT * FROM msgs",
    "store_trends_24h": _with(PREDS, MESSAGES, FACTORS)
    + ", store AS (SELECT m.\"timestamp\" AS ts, list_dot_product(CAST(u.features AS DOUBLE[]), "
    "CAST(i.features AS DOUBLE[])) AS prediction FROM msgs m "
    "LEFT JOIN factors u ON m.userId = u.id LEFT JOIN factors i ON m.movieId = i.id) "
    "SELECT CAST(hour(ts) AS BIGINT) AS hour, round(avg(prediction), 6) AS avg_rating, "
    "count(*) AS n_predictions FROM store WHERE ts >= (SELECT max(ts) FROM store) - INTERVAL 24 HOURS "
    "GROUP BY 1",
    "stream_score_sink": _with(PREDS, MESSAGES, FACTORS)
    + "SELECT m.userId, m.movieId, m.rating, m.\"timestamp\", round(list_dot_product("
    "CAST(u.features AS DOUBLE[]), CAST(i.features AS DOUBLE[])), 6) AS prediction, "
    "CAST(m.\"timestamp\" AS DATE) AS event_date FROM msgs m "
    "LEFT JOIN factors u ON m.userId = u.id LEFT JOIN factors i ON m.movieId = i.id",
    "als_train_score": _with(RATINGS)
    + ", parts AS (SELECT *, ((userId + movieId) % 10 + 10) % 10 < 8 AS is_train FROM ratings) "
    "SELECT userId, movieId, rating, ts, true AS has_score FROM parts WHERE NOT is_train "
    "AND userId IN (SELECT userId FROM parts WHERE is_train) AND movieId IN (SELECT movieId FROM parts WHERE is_train)",
    "dash_user_top_size": _with(PREDS)
    + f"SELECT CAST({DASH_USER} AS BIGINT) AS userId, least(count(*), 5) AS n_items FROM preds WHERE userId = {DASH_USER}",
    "csv_inferred": _with(RATINGS)
    + "SELECT CAST(year(ts) AS BIGINT) AS rating_year, count(*) AS n_rows, "
    "CAST(sum(userId + movieId) AS BIGINT) AS sum_ids, sum(rating) AS sum_rating FROM ratings GROUP BY 1",
    "movies_csv_roundtrip": _with(MOVIES)
    + "SELECT movieId, 'The \"' || title || '\", part ' || movieId || '; a|b' AS title, genres FROM movies",
    "stream_earliest": _with(PREDS, MESSAGES) + "SELECT * FROM msgs",
    "stream_latest": _with(PREDS.replace("FROM events", "FROM events WHERE event_id % 2 = 1"), MESSAGES) + "SELECT * FROM msgs",
    "csv_rejects": _with(PREDS)
    + "SELECT CASE event_id % 20 WHEN 0 THEN 'rating' WHEN 1 THEN 'fields' WHEN 2 THEN 'time' WHEN 3 THEN 'user' ELSE 'stored' END AS what, "
    "count(*) AS n, CAST(sum(userId) FILTER (WHERE event_id % 20 > 3) AS BIGINT) AS sum_user FROM preds GROUP BY 1",
    "stream_timed": _with(PREDS, MESSAGES) + "SELECT * FROM msgs",
    "stream_console": "SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS input_rows FROM events "
    "UNION ALL SELECT 1, count(*) FROM events WHERE event_id % 2 = 1",
    "stream_two_models": " UNION ALL ".join(
        "SELECT * FROM ("
        + _with(PREDS.replace("FROM events", f"FROM events WHERE event_id % 2 = {half}"), MESSAGES, FACTORS, STORED)
        + f"SELECT userId, movieId, \"timestamp\", round({half + 1} * prediction, 6) AS prediction, {half + 1} AS model_version FROM stored)"
        for half in (0, 1)
    ),
    "store_folded": _with(PREDS, MESSAGES, FACTORS, STORED)
    + "SELECT userId, movieId, rating, \"timestamp\", round(prediction, 6) AS prediction, event_date FROM stored",
    "store_latest_10": _with(PREDS, MESSAGES, FACTORS, STORED)
    + "SELECT userId, movieId, round(prediction, 6) AS prediction, \"timestamp\" FROM stored "
    "ORDER BY \"timestamp\" DESC, movieId DESC, userId DESC LIMIT 10",
    "store_item_stats": _with(PREDS, MESSAGES, FACTORS, STORED)
    + f"SELECT CAST({DASH_ITEM} AS BIGINT) AS movieId, round(avg(prediction), 6) AS avg_rating, count(*) AS count_ratings, "
    f"round(max(prediction), 6) AS max_rating, round(min(prediction), 6) AS min_rating FROM stored WHERE movieId = {DASH_ITEM} HAVING count(*) > 0",
    "store_user_top": _with(PREDS, MESSAGES, FACTORS, STORED)
    + f"SELECT movieId, round(prediction, 6) AS prediction FROM stored WHERE userId = {DASH_USER} "
    "ORDER BY stored.prediction DESC NULLS LAST, movieId LIMIT 5",
    "panel_stats": _with(PREDS, MESSAGES, FACTORS, STORED)
    + "SELECT count(*) AS total_predictions, round(avg(prediction), 2) AS avg_prediction, "
    "count(DISTINCT userId) AS unique_users FROM stored",
    "panel_top_items": _with(PREDS, MESSAGES, FACTORS, STORED)
    + "SELECT CAST(movieId AS BIGINT) AS movieId, round(avg(prediction), 6) AS average_rating, count(*) AS total_ratings "
    "FROM stored GROUP BY movieId HAVING count(*) >= 5 ORDER BY avg(prediction) DESC NULLS LAST, stored.movieId LIMIT 10",
    "panel_trends_24h": _with(PREDS, MESSAGES, FACTORS, STORED)
    + "SELECT CAST(hour(\"timestamp\") AS BIGINT) AS hour, round(avg(prediction), 6) AS avg_rating, count(*) AS n_predictions "
    "FROM stored WHERE \"timestamp\" >= (SELECT max(\"timestamp\") FROM stored) - INTERVAL 24 HOURS GROUP BY 1",
    "panel_summary": _with(PREDS, MESSAGES, FACTORS, STORED)
    + "SELECT count(*) AS total_predictions, count(DISTINCT userId) FILTER (WHERE \"timestamp\" >= "
    "(SELECT max(\"timestamp\") FROM stored) - INTERVAL 24 HOURS) AS active_users_24h, round(avg(prediction), 6) AS avg_rating FROM stored",
    "panel_distribution": _with(PREDS, MESSAGES, FACTORS, STORED)
    + "SELECT round(prediction, 6) AS prediction, CAST(count(*) AS BIGINT) AS n_predictions FROM stored "
    "WHERE prediction IS NOT NULL GROUP BY 1",
    "wide_duplicate_summary": "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, "
    "CAST(sum(n) AS BIGINT) - count(*) AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)",
    "wide_duplicate_groups": "SELECT text, lang, source, count(*) AS n_copies FROM documents GROUP BY text, lang, source HAVING count(*) > 1",
    "wide_dedup": "SELECT DISTINCT text, lang, source FROM documents",
    "stream_decode": "SELECT CAST(event_id AS VARCHAR) AS key, event_type || '/' || user_id AS value FROM events",
    "stream_rejects": _with(PREDS)
    + ", msgs AS (SELECT CASE event_id % 10 WHEN 0 THEN 'not json ' || event_id "
    "WHEN 1 THEN '{\"userId\": ' || (userId + 3000000000) || ', \"movieId\": ' || movieId || '}' "
    "WHEN 2 THEN '{\"userId\": ' || userId || '}' ELSE 'stored' END AS value FROM preds) "
    "SELECT value, count(*) AS n FROM msgs GROUP BY value",
    "stream_two_queries": _with(PREDS)
    + "SELECT 'raw' AS query, count(*) AS n_rows, CAST(NULL AS BIGINT) AS sum_user FROM preds "
    "UNION ALL SELECT 'parsed', count(*), CAST(sum(userId) AS BIGINT) FROM preds",
}
