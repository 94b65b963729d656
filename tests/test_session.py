from types import SimpleNamespace

import pytest

from panelcraft.session import ensure_checkpoint_dir


def _session(master, configured=None):
    set_to = []
    sc = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: None,
        getConf=lambda: SimpleNamespace(get=lambda k, d=None: configured),
        setCheckpointDir=set_to.append,
    )
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: None)), set_to


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_cluster_without_checkpoint_folder_raises(master):
    spark, _ = _session(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(spark)


def test_named_folder_is_used_and_local_gets_a_scratch_one():
    spark, used = _session("yarn", "hdfs://shared/x")
    ensure_checkpoint_dir(spark)
    assert used == ["hdfs://shared/x"]
    spark, used = _session("local[4]")
    ensure_checkpoint_dir(spark)
    assert len(used) == 1
