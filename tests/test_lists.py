"""Runs published by lists of files: readers see whole runs only."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tidewharf.sinks import (
    RunRefused, file_sink, latest_run, lists, published_runs, read_run, remove_unlisted, run_list,
)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def put(spark, path, rows=(0, 3), **options):
    df = spark.range(*rows).withColumn("k", F.expr("IF(id % 3 = 0, NULL, concat('a/b%=', id % 2))"))
    return file_sink(df, path, **{"fmt": "parquet", "listed": True, **options})


def ids(spark, path, run=None):
    return sorted(r.id for r in read_run(spark, path, run).collect())


def test_modes(spark, path):
    assert put(spark, path) == path
    with pytest.raises(FileExistsError):
        put(spark, path)
    put(spark, path, (3, 5), mode="append")
    assert ids(spark, path) == [0, 1, 2, 3, 4]
    put(spark, path, (9, 10), mode="ignore")
    assert ids(spark, path) == [0, 1, 2, 3, 4]
    put(spark, path, (7, 9), mode="overwrite")
    assert ids(spark, path) == [7, 8] and len(published_runs(spark, path)) == 3
    assert ids(spark, path, published_runs(spark, path)[0]) == [0, 1, 2]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc", "xml"])
def test_partitions_and_formats_come_back(spark, path, rows, fmt):
    df = spark.range(30).selectExpr("id", "IF(id % 3 = 0, NULL, concat('a/b%= é', id % 2)) AS k", "id / 7 AS x",
                                    "IF(id % 5 = 0, '', 'v') AS v")
    file_sink(df, path, fmt, listed=True, partition_by=["k"], null_value="\\N")
    got = read_run(spark, path)
    assert got.dtypes == df.dtypes
    assert rows(got) == rows(df)


@pytest.mark.parametrize("step", ["write", "_files", "create_once"])
def test_stopped_at_any_step(spark, path, monkeypatch, step):
    put(spark, path)

    def stop(*_, **__):
        raise RuntimeError("stopped")

    if step == "write":
        bad = spark.range(4).selectExpr("IF(id = 3, raise_error('stopped'), id) AS id", "'x' AS k")
        with pytest.raises(Exception, match="stopped"):
            file_sink(bad, path, "parquet", listed=True, mode="overwrite")
    else:
        monkeypatch.setattr(lists, step, stop)
        with pytest.raises(RuntimeError):
            put(spark, path, (5, 9), mode="overwrite")
        monkeypatch.undo()
    assert ids(spark, path) == [0, 1, 2] and len(published_runs(spark, path)) == 1
    put(spark, path, (5, 6), mode="overwrite")
    assert ids(spark, path) == [5]


def test_a_driver_that_dies_leaves_only_unlisted_files(spark, path, monkeypatch):
    put(spark, path)
    monkeypatch.setattr(lists, "create_once", lambda *_: (_ for _ in ()).throw(SystemExit()))
    with pytest.raises(SystemExit):  # not an Exception: nothing is tidied
        put(spark, path, (5, 9), mode="append")
    monkeypatch.undo()
    assert ids(spark, path) == [0, 1, 2]
    assert len(os.listdir(f"{path}/data")) == 2
    assert remove_unlisted(spark, path) == []
    assert len(remove_unlisted(spark, path, older_than_s=-5)) == 1
    assert ids(spark, path) == [0, 1, 2]


def test_files_beside_a_list_are_not_read(spark, path):
    put(spark, path)
    folder = run_list(spark, path)["files"][0]["name"].rsplit("/", 1)[0]
    spark.range(100, 103).selectExpr("id", "'late' AS k").coalesce(1).write.mode("append").parquet(f"{path}/{folder}")
    assert ids(spark, path) == [0, 1, 2]


def test_of_writers_at_once_one_is_refused(spark, path, monkeypatch):
    put(spark, path)
    ready, real, outcomes = threading.Barrier(4), lists.create_once, []

    def together(*args):
        ready.wait(60)
        return real(*args)

    monkeypatch.setattr(lists, "create_once", together)

    def write(i):
        try:
            put(spark, path, (10 * i, 10 * i + 2), mode="append")
            outcomes.append(i)
        except RunRefused:
            outcomes.append(None)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 5)]
    [t.start() for t in threads], [t.join() for t in threads]
    won = [i for i in outcomes if i]
    assert len(won) == 1 and outcomes.count(None) == 3
    assert ids(spark, path) == [0, 1, 2, 10 * won[0], 10 * won[0] + 1]
    assert len(os.listdir(f"{path}/data")) == 2


def test_stamped_runs(spark, path):
    from datetime import datetime
    for day in (1, 2):
        put(spark, path, (day, day + 1), run_stamp="%Y%m%d", now=datetime(2024, 1, day))
    assert published_runs(spark, path) == ["20240101", "20240102"]
    assert ids(spark, path) == [2] and ids(spark, path, "20240101") == [1]
    with pytest.raises(RunRefused):
        put(spark, path, run_stamp="%Y%m%d", now=datetime(2024, 1, 2), mode="overwrite")
    with pytest.raises(ValueError, match="stamped"):
        put(spark, path)
    with pytest.raises(ValueError, match="read_run"):
        latest_run(spark, path)
    with pytest.raises(LookupError):
        read_run(spark, path, "20240103")


def test_empty_runs_and_bad_settings(spark, path):
    put(spark, path, (0, 0), partition_by=["k"])
    assert ids(spark, path) == [] and read_run(spark, path).columns == ["id", "k"]
    with pytest.raises(ValueError, match="load"):
        file_sink(spark.sql("SELECT 1 AS load"), path, "parquet", listed=True, mode="append")
    with pytest.raises(ValueError, match="schema"):
        file_sink(spark.sql("SELECT 1 AS other"), path, "parquet", listed=True, mode="append")
    with pytest.raises(ValueError, match="staging"):
        put(spark, path, transaction=True)
