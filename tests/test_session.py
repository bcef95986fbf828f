"""Session helpers: cluster settings and the shared checkpoint folder."""

import types

import pytest

from ledgerlens.session import cluster_conf, ensure_checkpoint_dir


def test_cluster_conf_sizes_shuffles_from_cores():
    conf = cluster_conf(4000)
    assert conf["spark.sql.shuffle.partitions"] == "16000"
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert "spark.ui.enabled" not in conf


def test_checkpoint_dir_comes_from_the_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()


def test_a_cluster_needs_a_shared_folder():
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, default=None: None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)
