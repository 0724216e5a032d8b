"""The shared folder of sessions with and without spark.checkpoint.dir."""

from types import SimpleNamespace

import pytest

from tidemark.llm import scratch


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_a_local_session_without_a_folder_gets_one_and_keeps_it():
    found = scratch.shared_folder(session("local[2]"))
    assert found.startswith("file:///tmp/") and scratch.shared_folder(session("local[2]")) == found
    assert scratch.shared_folder(session("local[4]")) != found


def test_a_cluster_must_name_its_folder():
    assert scratch.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        scratch.shared_folder(session("yarn"))


def test_tables_are_stored_without_a_setting(spark):
    assert scratch.stored(spark.range(3), "three").count() == 3
