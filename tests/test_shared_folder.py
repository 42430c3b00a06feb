"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from linepatterns.sources.shared import shared_folder


def session(master, folder=None):
    set_to = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=set_to.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default), sparkContext=context), set_to


def test_folder_of_the_session():
    assert shared_folder(session("spark://host:7077", "hdfs:///shared")[0]) == "hdfs:///shared"


def test_no_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077")[0])


def test_local_sessions_get_one():
    spark, set_to = session("local[2]")
    assert [shared_folder(spark)] == set_to
