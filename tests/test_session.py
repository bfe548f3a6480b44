"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from cellwise import session


def fake(master, conf=None):
    held = {}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: held.get("dir"), setCheckpointDir=lambda d: held.update(dir=d))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf or default))


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake("spark://host:7077"))
    assert session.checkpoint_root(fake("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert "cellwise-" in session.checkpoint_root(fake("local[4]"))
