"""Small control files (manifests, pointers) on whatever file system holds a table, through Hadoop's client.

Only names and small JSON texts pass through here; rows are always read and written by Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession


class FileConflict(RuntimeError):
    """Another writer created the file first."""


def _path(spark: SparkSession, path: str) -> Any:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str) -> Any:
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_fs(spark, path).exists(_path(spark, path)))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted; none if its folder is missing."""
    found = _fs(spark, pattern).globStatus(_path(spark, pattern))
    return sorted(str(s.getPath().toString()) for s in found or ())


def data_size(spark: SparkSession, paths: Iterable[str]) -> int:
    """Bytes of all files under these folders."""
    return sum(int(_fs(spark, p).getContentSummary(_path(spark, p)).getLength()) for p in paths)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        _fs(spark, p).delete(_path(spark, p), True)


def read_json(spark: SparkSession, path: str) -> Any:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: Any, replace: bool = False) -> None:
    """Write a small file so that readers see it whole or not at all.

    The text goes to a hidden neighbour first and is renamed. Without ``replace`` the rename
    fails with ``FileConflict`` when the name is taken, so of two writers one wins. (On object
    stores without an atomic rename the deployer has to serialise writers.)
    """
    jvm = spark.sparkContext._jvm
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    out = _fs(spark, hidden).create(_path(spark, hidden), True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        out.close()
    how = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if replace else how.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, hidden).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, hidden), _path(spark, path), options)
    except Exception as exc:
        delete(spark, [hidden])
        if not replace and exists(spark, path):
            raise FileConflict(path) from exc
        raise
