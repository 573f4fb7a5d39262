import os
from types import SimpleNamespace

import pytest

from corvane import staging


def session(master, folder=None):
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: folder))
    return SimpleNamespace(sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        staging.stage_root(session("spark://host:7077"))
    assert staging.stage_root(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared/corvane"
    assert staging.stage_root(session("local[2]")).startswith("file:/")


def test_staged_tables_are_read_back_and_dropped(spark):
    made = staging.stage(spark.range(9).selectExpr("id % 3 as part", "id"), "t", ["part"])
    assert made.columns == ["part", "id"] and made.count() == 9 and made.where("part = 1").count() == 3
    path = made._staged_path.removeprefix("file://")
    assert os.path.isdir(path)
    with staging.open_shared(next(f for f in made.inputFiles())) as file:
        assert file.read(4) == b"PAR1"
    staging.drop(made)
    assert not os.path.exists(path)
