"""Checkpoint folder: read from the session, chosen locally only when unset."""

from __future__ import annotations

import os

import pytest

from ratelake import session as S


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, current=None):
        self.current = current
        self.set_to = None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.set_to = path


class _Session:
    def __init__(self, conf, context):
        self.conf = _Conf(conf)
        self.sparkContext = context


def test_cluster_setting_is_used_and_never_replaced():
    ctx = _Context()
    got = S.ensure_checkpoint_dir(_Session({S.CHECKPOINT_CONF: "hdfs://nn/shared/ckpt"}, ctx))
    assert got == "hdfs://nn/shared/ckpt" and ctx.set_to == "hdfs://nn/shared/ckpt"
    ctx2 = _Context(current="hdfs://nn/shared/ckpt/abc")
    S.ensure_checkpoint_dir(_Session({S.CHECKPOINT_CONF: "hdfs://nn/shared/ckpt"}, ctx2))
    assert ctx2.set_to is None


def test_local_fallback_only_when_unset(monkeypatch):
    monkeypatch.setattr(S, "_LOCAL_ROOT", None)
    ctx = _Context()
    local = {"spark.master": "local[4]"}
    got = S.ensure_checkpoint_dir(_Session(local, ctx))
    assert os.path.isdir(got) and ctx.set_to == got
    assert S.ensure_checkpoint_dir(_Session(local, _Context())) == got  # one folder per process


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", None])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(_Session({"spark.master": master} if master else {}, _Context()))


def test_a_folder_set_on_the_context_is_used():
    ctx = _Context(current="hdfs://nn/shared/ckpt/abc")
    assert S.ensure_checkpoint_dir(_Session({"spark.master": "yarn"}, ctx)) == "hdfs://nn/shared/ckpt/abc"
    assert ctx.set_to is None


def test_scratch_folders_are_removed(spark):
    a, b = S.scratch_path(spark, "gone"), S.scratch_path(spark, "stays")
    for path in (a, b):
        spark.range(3).write.parquet(path)
    S.remove_scratch(spark, a)
    assert not os.path.exists(a) and os.path.isdir(b)
    S.remove_scratch(spark, b)


def test_scratch_paths_are_fresh_and_under_the_shared_folder():
    sess = _Session({S.CHECKPOINT_CONF: "/shared/ckpt"}, _Context(current="/shared/ckpt/x"))
    a, b = S.scratch_path(sess, "out"), S.scratch_path(sess, "out")
    assert a != b and a.startswith("/shared/ckpt/scratch/out-")
