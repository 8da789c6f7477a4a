"""Versioned model folders: a new model appears beside the old one and is switched to by one pointer.

::

    <root>/version=<n>/userFactors, itemFactors (and what else the model saves)
    <root>/current.json     {"version": n}

A version's folder is written whole before the pointer is replaced by one rename, so a reader finds the
old model or the new one, never half of one, and a failed write changes nothing. ``CurrentScorer``
looks at the pointer between micro-batches: a running stream scores with a new model from the next
micro-batch on, without a restart, and every row says which version scored it.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators import model as M
from ratelake.sources import files as FS


def _folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version:06d}"


def _pointer(root: str) -> str:
    return f"{root.rstrip('/')}/current.json"


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version the pointer names; None if nothing was published."""
    return FS.read_json(spark, _pointer(root))["version"] if FS.exists(spark, _pointer(root)) else None


def _next(spark: SparkSession, root: str) -> int:
    """A number above every folder there is, one left behind by a failed write included."""
    return 1 + max((int(p.rsplit("=", 1)[1]) for p in FS.matching(spark, f"{root.rstrip('/')}/version=*")), default=0)


def publish_model(spark: SparkSession, model: ALSModel, root: str) -> int:
    """Save ``model`` as a new version and point to it; returns its number."""
    version = _next(spark, root)
    model.write().save(_folder(root, version))
    FS.write_json(spark, _pointer(root), {"version": version}, replace=True)
    return version


def publish_factors(user_factors: DataFrame, item_factors: DataFrame, root: str) -> int:
    """The same for factor tables (id, features) from elsewhere."""
    spark = user_factors.sparkSession
    version = _next(spark, root)
    user_factors.write.parquet(f"{_folder(root, version)}/userFactors")
    item_factors.write.parquet(f"{_folder(root, version)}/itemFactors")
    FS.write_json(spark, _pointer(root), {"version": version}, replace=True)
    return version


def load_version(spark: SparkSession, root: str, version: int | None = None) -> ALSModel:
    """A published model, by default the current one."""
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no model is published under {root}")
    return ALSModel.load(_folder(root, version))


def factors(spark: SparkSession, root: str, version: int) -> tuple[DataFrame, DataFrame]:
    """The user and item factors of a version."""
    user, item = (spark.read.parquet(f"{_folder(root, version)}/{name}") for name in ("userFactors", "itemFactors"))
    return user, item


def remove_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions; the current one always stays. Returns how many went."""
    now = current_version(spark, root)
    old = [p for p in FS.matching(spark, f"{root.rstrip('/')}/version=*")[:-keep] if int(p.rsplit("=", 1)[1]) != now]
    FS.delete(spark, old)
    return len(old)


class CurrentScorer:
    """Scores a micro-batch with the current version; the tables of the version before are released on a switch."""

    def __init__(self, spark: SparkSession, root: str, cold_start: str = "nan"):
        self.spark, self.root, self.cold_start = spark, root, cold_start
        self.version: int | None = None
        self.scorer = None

    def __call__(self, batch: DataFrame) -> DataFrame:
        version = current_version(self.spark, self.root)
        if version is None:
            raise FileNotFoundError(f"no model is published under {self.root}")
        if version != self.version:
            self.release()
            self.scorer = M.factor_scorer(*factors(self.spark, self.root, version), cold_start=self.cold_start)
            self.version = version
        return self.scorer(batch).withColumn("model_version", F.lit(version))

    def release(self) -> None:
        if self.scorer is not None:
            self.scorer.release()
        self.scorer, self.version = None, None
