"""Fixed schemas of the rating data model.

Ids are int (ALS accepts nothing wider), ratings are float, times are a single
typed timestamp column end to end (message epochs, ISO strings and missing
times all parse into it).
"""

from pyspark.sql import types as T

MOVIES = T.StructType(
    [
        T.StructField("movieId", T.IntegerType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("genres", T.StringType(), True),
    ]
)

RATINGS = T.StructType(
    [
        T.StructField("userId", T.IntegerType(), True),
        T.StructField("movieId", T.IntegerType(), True),
        T.StructField("rating", T.FloatType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
    ]
)

# JSON payload of one rating message. TimestampType accepts epoch seconds,
# ISO strings and an absent field (null).
MESSAGE = T.StructType(
    [
        T.StructField("userId", T.IntegerType(), True),
        T.StructField("movieId", T.IntegerType(), True),
        T.StructField("rating", T.FloatType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
    ]
)

# The prediction store: what the dashboard reads from a store that holds no row yet.
PREDICTIONS = T.StructType(
    [
        T.StructField("userId", T.IntegerType(), True),
        T.StructField("movieId", T.IntegerType(), True),
        T.StructField("prediction", T.FloatType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("event_date", T.DateType(), True),
    ]
)

# The CSV time layout and the genre separator of the item table.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
GENRE_SEPARATOR = "|"
