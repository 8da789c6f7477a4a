"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.session import ensure_checkpoint_dir

# A side is broadcast only when it holds at most this many (narrow) rows.
MAX_BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, safe when an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int, bound: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``bound``; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= bound else df


def inline_table(spark: SparkSession, schema: str, rows: Iterable[str]) -> DataFrame:
    """A bounded driver-side table as a DataFrame, through a JSON literal (stays in the JVM)."""
    text = "[" + ",".join(rows) + "]"
    return spark.sql(f"SELECT inline(from_json(:doc, 'array<struct<{schema}>>'))", args={"doc": text})


def top_bits(hashed: Column, bits: int) -> Column:
    """The ``bits`` highest bits of a 64-bit hash as a non-negative integer."""
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any case."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_plain_names(df: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(df)``, with columns of ``df`` that begin with two underscores (the operators' own names) renamed meanwhile."""
    held: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("__"):
            held[c] = free_name(df, "held" + c)
    if not held:
        return run(df)
    back = {v: c for c, v in held.items()}
    out = run(df.withColumnsRenamed(held))
    return out.withColumnsRenamed({v: c for v, c in back.items() if v in out.columns})
