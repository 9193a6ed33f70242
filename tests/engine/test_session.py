"""The folder of tables that cut lineage."""

import pytest

from lattisphere.plans import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    """A session, as far as shared_dir looks at it."""

    def __init__(self, master, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_shared_folder():
    assert session.shared_dir(Fake("spark://a:7077", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        alone = Fake(master)
        assert session.shared_dir(alone) == session.shared_dir(alone) and session.shared_dir(alone).startswith("file://") and not alone.conf
    for master in ("local-cluster[2,1,512]", "spark://a:7077", "yarn", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Fake(master))
