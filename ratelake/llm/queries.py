"""The operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelake.llm import credentials, decontam, imi, kneser, langid, licences, lpf, mixing, repair, ring, simhash, warc, whiten
from ratelake.llm.common import read_table


def op1_inverted_multi_index(spark: SparkSession, d: str) -> DataFrame:
    return imi.search(read_table(spark, d, "embeddings"), every=50, k=5)


def op2_spaced_seeds(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


def op3_ring_shards(spark: SparkSession, d: str) -> DataFrame:
    return ring.shard_report(read_table(spark, d, "documents"), shards=24)


def op4_temperature_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(read_table(spark, d, "documents"), max_repeats=1.5)


def op5_covering_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, d, "documents"), width=4, seed=42, radius=4)


def op6_word_backoff_language(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_report(read_table(spark, d, "documents"))


def op7_guess_cost_secrets(spark: SparkSession, d: str) -> DataFrame:
    return credentials.span_report(read_table(spark, d, "documents"))


def op8_longest_previous_factor(spark: SparkSession, d: str) -> DataFrame:
    return lpf.repeat_report(read_table(spark, d, "documents"), length=400)


def op9_conditional_compression(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(read_table(spark, d, "documents"))


def op10_kneser_ney_quality(spark: SparkSession, d: str) -> DataFrame:
    return kneser.quality_report(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


def op11_jacobi_davidson_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whiten.whitening_report(read_table(spark, d, "embeddings"), components=8)


def op12_content_addressed_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive_report(read_table(spark, d, "pages"), least=0)


def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair_report(read_table(spark, d, "conversations"))


QUERIES = {
    "op1_inverted_multi_index": op1_inverted_multi_index,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_ring_shards": op3_ring_shards,
    "op4_temperature_mix": op4_temperature_mix,
    "op5_covering_simhash": op5_covering_simhash,
    "op6_word_backoff_language": op6_word_backoff_language,
    "op7_guess_cost_secrets": op7_guess_cost_secrets,
    "op8_longest_previous_factor": op8_longest_previous_factor,
    "op9_conditional_compression": op9_conditional_compression,
    "op10_kneser_ney_quality": op10_kneser_ney_quality,
    "op11_jacobi_davidson_whitening": op11_jacobi_davidson_whitening,
    "op12_content_addressed_warc": op12_content_addressed_warc,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op2_spaced_seeds": decontam.oracle_sql(),
    "op8_longest_previous_factor": lpf.oracle_sql(),
    "op12_content_addressed_warc": warc.oracle_sql(),
    "op13_conversation_repair": repair.oracle_sql(),
}
