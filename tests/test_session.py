"""work_root: the cluster folder when set; a registered private folder otherwise."""

from hirelens.session import work_root


class _Conf:
    def __init__(self, value, master=None):
        self.value, self.master = value, master

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self.value, "spark.master": self.master}.get(key) or default

    def set(self, key, value):                      # Spark rejects this for core configs
        raise AssertionError("must not set spark.checkpoint.dir at run time")


class _Ctx:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, value, master=None):
        self.conf, self.sparkContext = _Conf(value, master), _Ctx()


def test_uses_cluster_folder():
    s = _Spark("hdfs://shared/ckpt/")
    assert work_root(s) == "hdfs://shared/ckpt"
    assert s.sparkContext.dir == "hdfs://shared/ckpt/"


def test_private_folder_only_when_unset():
    s = _Spark(None)
    root = work_root(s)
    assert root and s.sparkContext.dir == root
    assert work_root(s) == root                     # stable afterwards


def test_a_cluster_needs_a_shared_folder():
    import pytest
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            work_root(_Spark(None, master))
    assert work_root(_Spark(None, "local[8]"))
