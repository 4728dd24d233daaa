from types import SimpleNamespace

import pytest

from spillway.llm import common


def session(master, folder=None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            common.shared_folder(session(master))
        assert common.shared_folder(session(master, "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("local", "local[4]", "local[*]"):
        one = session(master)
        assert common.shared_folder(one).startswith("file:///") and common.shared_folder(one) == one.conf.get("spark.checkpoint.dir")
