import types

import pytest

from siltworks import session


def fake(master, folder=None, conf=None):
    held = types.SimpleNamespace(folder=folder)
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: held.folder, setCheckpointDir=lambda f: setattr(held, "folder", f))
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d: conf or d)), held


def test_a_shared_folder_is_demanded_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://x"):
        spark, held = fake(master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(spark)
        spark, held = fake(master, conf="hdfs://shared")
        session.ensure_checkpoint_dir(spark)
        assert held.folder == "hdfs://shared"
    for master in ("local", "local[*]", "local[4,2]"):
        spark, held = fake(master)
        session.ensure_checkpoint_dir(spark)
        assert held.folder
    spark, held = fake("yarn", folder="kept")
    session.ensure_checkpoint_dir(spark)
    assert held.folder == "kept"
