"""Tables in between, and what the driver's entry hides."""

import sys

import pytest

import __spark_entry__
from quillframe.errors import InvalidParameterError
from quillframe.plans import scratch


class Conf(dict):
    def set(self, name, value):
        self[name] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(InvalidParameterError):
        scratch.scratch_dir(Session(spark_master="spark://host:7077"))
    with pytest.raises(InvalidParameterError):
        scratch.scratch_dir(Session(spark_master="local-cluster[2,1,1024]"))
    assert scratch.scratch_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"
    assert scratch.scratch_dir(Session(spark_master="local[4]")).startswith("file://")


def test_tables_of_a_step_go_when_it_ends(spark):
    paths = []

    def make():
        first = scratch.durable(spark.range(5))
        paths.extend(first.inputFiles())
        second = scratch.settled(lambda: scratch.durable(first.where("id > 1")))
        paths.extend(second.inputFiles())
        return second.where("id > 2")

    out = scratch.settled(make)
    assert sorted(r.id for r in out.collect()) == [3, 4]
    import os

    assert paths and not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    with pytest.raises(ZeroDivisionError):
        scratch.settled(lambda: 1 / 0)
    assert sorted(r.id for r in scratch.durable(spark.range(2)).collect()) == [0, 1]


def test_entry_hides_only_absent_folders(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found, _ = __spark_entry__._llm()
    assert found == {}
