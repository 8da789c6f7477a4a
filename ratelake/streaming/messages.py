"""Structured Streaming: message source, parse, score, sinks.

Every stream in the reference is stateless map-and-append: decode the message
value, parse JSON, flatten, score against a static model, append to a sink.
Here the parse and score stages are ordinary DataFrame functions, so the same
code runs on a stream and on a batch table. The store sink is Spark's file
sink with a mandatory checkpoint (exactly-once across restarts), not a
collect to the driver per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from ratelake.schemas import MESSAGE
from ratelake.sources import files as FS
from ratelake.streaming import panels as P

# Starting positions a message source accepts.
STARTING_OFFSETS = ("latest", "earliest", None)


def message_stream(
    spark: SparkSession,
    fmt: str = "kafka",
    options: dict[str, str] | None = None,
    starting_offsets: str | None = None,
    schema: T.StructType | None = None,
    path: str | None = None,
    min_partitions: int | None = None,
) -> DataFrame:
    """Open a message stream.

    For Kafka pass ``kafka.bootstrap.servers`` and ``subscribe`` in
    ``options`` and choose ``starting_offsets`` (``latest``/``earliest``/None
    for the source default). The connector jar must be on the classpath. Any
    other streaming format (file sources in tests) takes a ``path`` and, for
    file formats, a ``schema``.

    ``min_partitions`` decouples processing parallelism from the source's: a
    single-partition topic (as in the reference's broker setup) otherwise
    parses and scores every message in one task.
    """
    if starting_offsets not in STARTING_OFFSETS:
        raise ValueError(f"starting_offsets must be one of {STARTING_OFFSETS}")
    reader = spark.readStream.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if starting_offsets is not None:
        reader = reader.option("startingOffsets", starting_offsets)
    if min_partitions and fmt == "kafka":
        # Kafka splits large offset ranges into more tasks by itself.
        reader = reader.option("minPartitions", str(min_partitions))
    stream = reader.load(path) if path is not None else reader.load()
    if min_partitions and fmt != "kafka":
        # Other sources: spread the raw messages before the CPU-heavy parse.
        stream = stream.repartition(min_partitions)
    return stream


def decode_messages(df: DataFrame, columns: Iterable[str] = ("key", "value")) -> DataFrame:
    """Cast the binary ``key``/``value`` columns (those present) to string."""
    present = [c for c in columns if c in df.columns]
    return df.select(*[F.col(c).cast("string").alias(c) for c in present])


def parse_messages(
    df: DataFrame,
    schema: T.StructType = MESSAGE,
    value_col: str = "value",
    keep: Iterable[str] = (),
) -> DataFrame:
    """JSON text -> typed, flattened rows (PERMISSIVE: bad fields become null).

    ``keep`` names input columns carried along (e.g. the raw ``value``, so a
    reject table can show what could not be parsed).
    """
    kept = [F.col(c) for c in keep]
    parsed = df.select(*kept, F.from_json(F.col(value_col).cast("string"), schema).alias("data"))
    return parsed.select(*kept, "data.*")


def split_valid(
    df: DataFrame,
    id_cols: Iterable[str] = ("userId", "movieId"),
    metrics_name: str = "messages",
) -> tuple[DataFrame, DataFrame]:
    """(rows with every id present, rejected rows).

    A null id makes ALS scoring fail the whole query; malformed messages (which
    parse to null ids) are routed to a reject sink instead.

    The parsed rows pass through ``observe`` first: it publishes ``rows`` and
    ``rejected`` counts with every micro-batch's progress, and it is also a
    node Catalyst does not push filters through. Without it the id filter is
    rewritten in terms of ``from_json`` and every message is parsed once per
    filtered field plus once for the output.
    """
    ok = None
    for c in id_cols:
        cond = F.col(c).isNotNull()
        ok = cond if ok is None else ok & cond
    watched = df.observe(
        metrics_name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~ok).alias("rejected"),
    )
    return watched.filter(ok), watched.filter(~ok)


def score_stream(df: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a static scorer (``model.transform`` or a ``score_factors`` partial).

    A stream-static join: the static factor tables are re-read per micro-batch
    plan; restart the query to pick up a newly trained model (the checkpoint
    makes restarting safe).
    """
    return scorer(df)


TASK_ROWS = 1 << 19  # rows of a micro-batch that one task writes: about 100 MB to sort

# Fixed value: what the console sink shows of a micro-batch unless told otherwise.
CONSOLE_ROWS = 20


def shown_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each partition. Every row is still read and computed.

    Spark's console sink ships a whole micro-batch to the driver to print a few of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = n
        for batch in batches:  # to the end, so that the micro-batch is processed and counted in whole
            if left:
                yield batch.slice(0, left)
                left -= min(left, batch.num_rows)

    return df.mapInArrow(run, df.schema)


def start_stream(
    df: DataFrame,
    sink: str = "parquet",
    path: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    output_mode: str = "append",
    partition_by: Iterable[str] | None = None,
    query_name: str | None = None,
    foreach_batch: Callable[[DataFrame, int], None] | None = None,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Start an append query.

    ``sink`` is ``parquet`` (the prediction store), ``console``, ``memory`` or
    any other format; ``foreach_batch`` is for external stores only. File and
    batch-function sinks require a checkpoint. ``trigger`` is passed through,
    e.g. ``{"processingTime": "2 seconds"}`` or ``{"availableNow": True}``; ``options`` go to the sink.
    The console gets only as many rows of a partition as it may show (``numRows``) and one more, by
    which it tells that there are more.

    After a failure a micro-batch is replayed with the same epoch id: the file
    sink commits each epoch once, while a ``foreach_batch`` function must make
    its write idempotent per epoch id (for example overwrite a folder named
    after it, or upsert on a key).
    """
    if sink == "console" and foreach_batch is None:
        told = {k.lower(): v for k, v in (options or {}).items()}
        df = shown_rows(df, int(told.get("numrows", CONSOLE_ROWS)) + 1)
    writer = df.writeStream.outputMode(output_mode)
    if foreach_batch is not None:
        writer = writer.foreachBatch(foreach_batch)
    else:
        writer = writer.format(sink)
    needs_checkpoint = foreach_batch is not None or sink not in ("console", "memory")
    if needs_checkpoint and not checkpoint:
        raise ValueError("a checkpoint location is required for this sink")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(**(trigger or {"processingTime": "2 seconds"}))
    return writer.start()


def start_many(specs: Iterable[tuple[DataFrame, dict]]) -> list[StreamingQuery]:
    """Start several queries over one parsed stream (e.g. raw rows and scores).

    Each query reads the source on its own and needs its own checkpoint.
    """
    return [start_stream(df, **kwargs) for df, kwargs in specs]


def dealt(df: DataFrame, by: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows. Rows of one value of ``by`` lie in neighbouring tasks, so it gets few files.

    A value of many rows takes several tasks, small ones share one: a task's sort before the write is as
    large for a micro-batch of a hundred million rows without a date as for one of a million.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).collect()  # a row a date
    sizes.sort(key=lambda r: [(r[c] is not None, r[c]) for c in by])
    places, at = [], 0
    for r in sizes:
        places.append({**{f"_by{i}": r[c] for i, c in enumerate(by)}, "_at": at, "_n": r["_n"]})
        at += r["_n"]
    kinds = [T.StructField(f"_by{i}", df.schema[c].dataType) for i, c in enumerate(by)]
    schema = T.StructType([*kinds, T.StructField("_at", T.LongType()), T.StructField("_n", T.LongType())])
    table = F.broadcast(df.sparkSession.createDataFrame(pa.Table.from_pylist(places, to_arrow_schema(schema))))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    spot = F.col("_at") + F.pmod(F.xxhash64("_row"), F.col("_n"))
    out = df.withColumn("_row", F.monotonically_increasing_id()).join(table, same)
    out = out.repartitionById(max(1, -(-at // rows)), F.floor(spot / rows).cast("int"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def epoch_writer(
    valid_path: str,
    reject_path: str,
    to_store: Callable[[DataFrame], DataFrame],
    id_cols: Iterable[str] = ("userId", "movieId"),
    partition_by: Iterable[str] = ("event_date",),
    panels: bool = False,
) -> Callable[[DataFrame, int], None]:
    """A batch hook that writes every parsed row to exactly one of two tables.

    Rows with every id go through ``to_store`` into ``valid_path``, the others
    into ``reject_path``: one query, one checkpoint, so no message can fall
    between two starts. Both tables carry an ``epoch`` partition named after
    the query and the micro-batch; a replayed micro-batch overwrites its own
    folders and nothing else. The store is rebalanced on its partition columns
    before the write, so a date gets a few files per micro-batch rather than
    one per task; beyond ``TASK_ROWS`` rows it is dealt by counts (``dealt``). ``panels`` also writes the micro-batch's partial aggregates
    (``streaming.panels``) beside the store, in a folder that a replay replaces.
    """
    ids, parts = list(id_cols), list(partition_by)

    def write(batch: DataFrame, epoch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the epoch writer runs inside a streaming query only")
        epoch = F.lit(f"{query}-{epoch_id}")
        ok = F.lit(True)
        for c in ids:
            ok = ok & F.col(c).isNotNull()

        def put(df: DataFrame, path: str, by: list[str]) -> None:
            if by:
                df = dealt(df, by, TASK_ROWS) if n > TASK_ROWS else df.hint("rebalance", *by)
            out = df.withColumn("epoch", epoch)
            writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(*by, "epoch").parquet(path)

        batch.persist()
        try:
            n = batch.count()
            stored = to_store(batch.filter(ok))
            cells = f"{valid_path}/_panels/epoch={query}-{epoch_id}"
            again = panels or n > TASK_ROWS  # read more than once
            if panels:
                FS.delete(batch.sparkSession, [cells])  # no reader meets cells older than their rows
            if again:
                stored = stored.persist()
            try:
                put(stored, valid_path, parts)
                if panels:
                    # Three cells a row at most, and those of the hours.
                    P.write(P.partials(stored), cells, -(-3 * n // TASK_ROWS) if 3 * n > TASK_ROWS else None)
            finally:
                if again:
                    stored.unpersist()
            put(batch.filter(~ok), reject_path, [])
        finally:
            batch.unpersist()

    return write


def run_available(query: StreamingQuery) -> StreamingQuery:
    """Block until an ``availableNow`` query has drained its input, then raise its error if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query
