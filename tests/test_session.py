"""spark.checkpoint.dir handling: read from the session, local scratch only in local mode."""

import pytest

from cashcurve.session import checkpoint_dir


class _Conf(dict):
    def get(self, key, default=None):
        if key in self:
            return self[key]
        if default is None and key not in self:
            raise KeyError(key)
        return default

    def set(self, key, value):
        self[key] = value


class _Session:
    def __init__(self, conf):
        self.conf = _Conf(conf)

    @property
    def sparkContext(self):          # like a Spark Connect session: no SparkContext
        raise RuntimeError("no SparkContext")


def test_configured_dir_is_used():
    s = _Session({"spark.checkpoint.dir": "s3a://bucket/ckpt", "spark.master": "yarn"})
    assert checkpoint_dir(s) == "s3a://bucket/ckpt"


def test_cluster_without_shared_dir_is_refused():
    s = _Session({"spark.master": "yarn"})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(s)


def test_local_without_dir_gets_scratch():
    s = _Session({"spark.master": "local[2]"})
    d = checkpoint_dir(s)
    assert d and s.conf["spark.checkpoint.dir"] == d
