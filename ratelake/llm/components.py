"""Connected components of a link table by alternating large and small stars.

Every round is joins and aggregations over the links, written to the shared
checkpoint folder; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.common import saved


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of a link with the smallest node of its component.

    Self links and nulls are ignored; nodes without links are not listed.
    """
    edges = saved(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct()
    )
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        edges = saved(
            small.select("u", F.col("m").alias("v"))
            .unionAll(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        got = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if state == (got["n"], got["s"]) or not got["n"]:
            break
        state = (got["n"], got["s"])
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
