"""Session construction and the shared scratch area.

Everything the library writes outside a caller-given path (round-trip checks,
stream outputs in the registered queries, ALS checkpoints) goes under the
cluster's shared ``spark.checkpoint.dir``. That setting is read from the
session; a local fallback is set only when it is missing (tests, laptops).
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_ROOT: str | None = None
_SCRATCH: list[str] = []

# Settings every job relies on. Shuffle width is left to AQE: the initial
# partition count is only an upper bound it coalesces from.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ui.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "ratelake",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One JVM on one machine: ``local`` or ``local[...]`` (``local-cluster`` has executors of its own)."""
    return re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or "") is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster the deployer names a shared folder (HDFS, object store) in
    ``spark.checkpoint.dir`` or with ``SparkContext.setCheckpointDir``; we never
    replace it. When neither is set, a temporary folder of this process is used
    on a local master, and any other master is an error: executors could not
    read what another machine wrote.
    """
    global _LOCAL_ROOT
    try:
        sc = spark.sparkContext
        own = sc.getCheckpointDir()
    except Exception:  # noqa: BLE001 - remote (Connect) sessions expose no SparkContext
        sc, own = None, None
    current = spark.conf.get(CHECKPOINT_CONF, None) or own
    if not current:
        if not _is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="ratelake-ckpt-")
            atexit.register(shutil.rmtree, _LOCAL_ROOT, ignore_errors=True)
        current = _LOCAL_ROOT
    if sc is not None and own is None:
        sc.setCheckpointDir(current)
    return current


def parallelism(spark: SparkSession, fallback: int = 8) -> int:
    """Default parallelism of the cluster (task slots), also for remote sessions."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        value = spark.conf.get("spark.default.parallelism", None)
        return int(value) if value else fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused folder under the shared checkpoint area, until ``remove_scratch``."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "scratch", f"{label}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    return path


def remove_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete these scratch folders (all of this process's if none is named) wherever they are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths or tuple(_SCRATCH):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _SCRATCH:
            _SCRATCH.remove(path)
