import os
from types import SimpleNamespace

import pytest

from tidewharf import session as session_module
from tidewharf.session import (
    CHECKPOINT_DIR, clear_scratch, scratch_database, scratch_dir, session_settings,
)


def session(master, base=None):
    settings = {CHECKPOINT_DIR: base} if base else {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=settings.get),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_scratch_goes_where_the_cluster_says():
    first = scratch_dir(session("yarn", "hdfs://ns/scratch/"), "x")
    second = scratch_dir(session("yarn", "hdfs://ns/scratch/"), "x")
    assert first.startswith("hdfs://ns/scratch/tidewharf-app-1/x-") and first != second


def test_a_cluster_must_say_where():
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        scratch_dir(session("spark://host:7077"), "x")


def test_a_local_session_gets_one_temporary_folder():
    first, second = (scratch_dir(session("local[2]"), "x") for _ in range(2))
    assert os.path.dirname(first) == os.path.dirname(second) and first != second
    assert os.path.isdir(os.path.dirname(os.path.dirname(first)))


def test_settings_are_put_back(spark):
    key, unset = "spark.sql.shuffle.partitions", "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(key), spark.conf.get(unset)
    with pytest.raises(KeyError):
        with session_settings(spark, {key: "3", unset: "5"}):
            assert spark.conf.get(key) == "3"
            raise KeyError
    assert (spark.conf.get(key), spark.conf.get(unset)) == before


def test_clear_scratch(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session_module, "_application_scratch", lambda spark: f"{tmp_path}/mine")
    monkeypatch.setattr(session_module, "_databases", {})
    db = scratch_database(spark, "gone")
    spark.range(3).write.saveAsTable(f"{db}.t")
    (tmp_path / "other").mkdir()
    clear_scratch(spark)
    assert not spark.catalog.databaseExists(db)
    assert os.listdir(tmp_path) == ["other"]
