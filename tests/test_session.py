"""The shared folder: where lineage cuts and intermediate tables go."""

import pytest
from pyspark.sql import DataFrameReader

import __spark_entry__
from mixtrace import session
from tests.conftest import SF001


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as on a cluster whose spark.checkpoint.dir is a mount (file:)."""
    assert spark.sparkContext.getCheckpointDir().startswith("file:")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://head:7077")
    monkeypatch.setattr(session, "_SHARED", set(), raising=False)
    return spark


def test_shared_mount_is_taken_on_a_cluster(cluster):
    assert sorted(r.id for r in session.cut(cluster.range(5)).collect()) == [0, 1, 2, 3, 4]
    path = session.scratch_path(cluster, "x")
    cluster.range(3).write.parquet(path)
    assert cluster.read.parquet(path).count() == 3


def test_shared_mount_is_tried_out_once(cluster):
    session.checkpoint_dir(cluster)
    folder = session.checkpoint_dir(cluster)
    assert session._SHARED == {folder}


@pytest.mark.parametrize("seen", ["part", "none"])
def test_machine_local_folder_is_an_error_on_a_cluster(cluster, monkeypatch, seen):
    def parquet(self, path):
        if seen == "none":
            raise FileNotFoundError(path)
        return cluster.range(1)
    monkeypatch.setattr(DataFrameReader, "parquet", parquet)
    with pytest.raises(RuntimeError, match="machine-local"):
        session.checkpoint_dir(cluster)


def test_unset_folder_is_an_error_on_a_cluster(cluster, monkeypatch):
    monkeypatch.setattr(cluster.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(type(cluster.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(RuntimeError, match="set spark.checkpoint.dir"):
        session.checkpoint_dir(cluster)


@pytest.mark.parametrize("name", ["collate_causal", "dense_index", "encode", "influence_loo", "op2_quality",
                                  "op3_substring_dedup", "op4_mixing", "op7_neighbours", "op9_token_files",
                                  "op10_simhash", "op13_decontamination"])
def test_queries_run_with_a_shared_mount_on_a_cluster(cluster, name):
    assert __spark_entry__.queries()[name](cluster, SF001).count() > 0
