"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from solfa.sources import storage


def session(master, path=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: path or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        storage.shared_folder(session("spark://host:7077"))
    assert storage.shared_folder(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    local = session("local[2]")
    assert storage.shared_folder(local) == storage.shared_folder(local)
