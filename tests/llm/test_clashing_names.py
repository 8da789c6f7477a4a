"""Stages keep columns whose names they use themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.llm import decontam, mixing, ring
from tests.llm.cases import PLAIN

OWN = ["__key", "__h", "__bucket", "__src", "__tokens", "__rank", "__B", "held__key"]


def test_columns_of_reserved_names_pass_through_every_native_stage(spark):
    rows = [(i, PLAIN * 3 if i == 0 else f"text {i} of some words", "ab"[i % 2], f"k{i}", i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `__key` string, `__h` int")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in OWN[2:]})
    plain = docs.select("doc_id", "text", "source")
    bench = spark.createDataFrame([(1, PLAIN)], "item_id long, text string")
    for run in (
        lambda d: decontam.without_contaminated(d, bench),
        mixing.mixed_documents,
        lambda d: ring.assign(d, shards=3),
    ):
        got = run(docs)
        extra = [c for c in got.columns if c not in docs.columns]
        assert [c for c in got.columns if c in docs.columns] == docs.columns
        want = run(plain)
        assert sorted(map(str, got.select(*plain.columns, *extra).collect())) == sorted(map(str, want.collect()))
        assert all(r["__key"] == f"k{r['doc_id']}" and r["__h"] == r["doc_id"] and r["__B"] == f"__B{r['doc_id']}" for r in got.collect())
