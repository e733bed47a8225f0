"""The folder for tables in progress."""

from types import SimpleNamespace

import pytest

from revlattice.llm.runtime import shared_dir


def test_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="app"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(spark, "x")
