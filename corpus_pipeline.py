"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratelake.llm import decontam, kneser, mixing, ring, simhash
from ratelake.llm.common import read_table
from ratelake.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rows whose perplexity leaves their language's limits go."""
    return kneser.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each component stays (four-word shingles, at most 4 bits).

    The smallest doc_id stays, null ids last; a row repeated in whole stays once; null and empty
    texts are one component.
    """
    return simhash.drop_near_duplicates(docs, width=4, seed=42, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows that overlap a benchmark item go."""
    return decontam.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing: small sources are repeated up to 1.5 times, rows laid out in block order."""
    return mixing.mixed_documents(docs, max_repeats=1.5)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Consistent-hash shards 0 to 23 with exactly even row counts."""
    return ring.assign(docs, shards=24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("keep_quality", keep_quality),
    ("drop_near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

# The classifier and the near-duplicate stage have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
