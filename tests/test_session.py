"""The checkpoint folder rule: taken from the session, never invented on a cluster."""

import pytest

from covary.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _RuntimeConf:
    def get(self, key):
        raise KeyError(key)


class _Context:
    def __init__(self, master, conf=None):
        self.master = master
        self._conf = _Conf(conf or {})
        self._dir = None

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self._dir = path


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext = _Context(master, conf)
        self.conf = _RuntimeConf()


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("spark://cluster:7077"))


def test_configured_dir_is_used(tmp_path):
    s = _Session("yarn", {"spark.checkpoint.dir": str(tmp_path / "ck")})
    assert ensure_checkpoint_dir(s) == str(tmp_path / "ck")


def test_local_session_gets_a_scratch_dir():
    s = _Session("local[2]")
    path = ensure_checkpoint_dir(s)
    assert path and s.sparkContext.getCheckpointDir() == path
