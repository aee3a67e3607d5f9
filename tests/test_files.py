import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewharf.sinks import file_sink, latest_run


@pytest.fixture
def people(spark):
    data = [(1, "a,b", "x"), (2, 'quo"te', "y"), (3, "", "x"), (4, None, None), (5, "é", "y")]
    return spark.createDataFrame(data, "id int, name string, grp string").repartition(2)


SCHEMA = "id int, name string, grp string"


def files(path, suffix=""):
    return [
        os.path.join(d, f) for d, _, names in os.walk(path) for f in names
        if f.startswith("part-") and f.endswith(suffix)
    ]


def test_text_round_trip_keeps_delimiters_empty_and_null(spark, people, rows, tmp_path):
    path = file_sink(people, f"{tmp_path}/out", "text", null_value="\\N")
    assert rows(spark.read.schema(SCHEMA).csv(path, nullValue="\\N")) == rows(people)


def test_delimiters(spark, people, rows, tmp_path):
    people = people.where("id <> 3").fillna("none")
    path = file_sink(people, f"{tmp_path}/out", field_delimiter="|", row_delimiter="\r\n")
    with open(files(path)[0], newline="") as f:
        text = f.read()
    assert "\r\n" in text and "|" in text
    assert rows(spark.read.schema(SCHEMA).csv(path, sep="|", lineSep="\r\n")) == rows(people)
    with pytest.raises(ValueError, match="row delimiter"):
        file_sink(people, f"{tmp_path}/bad", row_delimiter="###")
    with pytest.raises(ValueError, match="unknown format"):
        file_sink(people, f"{tmp_path}/bad", "xlsx")


@pytest.mark.parametrize("fmt,codec,suffix", [
    ("csv", "gzip", ".csv.gz"), ("json", "bzip2", ".json.bz2"), ("parquet", "zstd", ".zstd.parquet"),
    ("orc", "zlib", ".zlib.orc"), ("csv", "none", ".csv"),
])
def test_codec(people, tmp_path, fmt, codec, suffix):
    assert files(file_sink(people, f"{tmp_path}/out", fmt, codec=codec), suffix)


def test_partitioned_with_and_without_the_column(spark, people, rows, tmp_path):
    path = file_sink(people, f"{tmp_path}/plain", "parquet", partition_by=["grp"])
    assert {d for d in os.listdir(path) if "=" in d} == {
        "grp=x", "grp=y", "grp=__HIVE_DEFAULT_PARTITION__"
    }
    assert rows(spark.read.parquet(path).select("id", "name", "grp")) == rows(people)
    kept = file_sink(
        people, f"{tmp_path}/kept", "parquet", partition_by=["grp"], keep_partition_columns=True
    )
    assert "by_grp=x" in os.listdir(kept)
    assert spark.read.parquet(f"{kept}/by_grp=x").columns == ["id", "name", "grp"]


def test_partitioned_write_makes_few_files(spark, tmp_path):
    df = spark.range(0, 10_000, 1, 40).withColumn("k", F.expr("id % 5"))
    gathered = file_sink(df, f"{tmp_path}/a", "parquet", partition_by=["k"])
    spread = file_sink(df, f"{tmp_path}/b", "parquet", partition_by=["k"], rebalance=False)
    assert len(files(gathered)) <= 10 < len(files(spread))


def test_crowded_partition_is_split(spark, tmp_path):
    df = spark.range(0, 200_000, 1, 8).selectExpr("id", "IF(id % 10 = 0, id % 3, 7) AS k")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "100k")
    try:
        path = file_sink(df, f"{tmp_path}/out", "parquet", partition_by=["k"])
    finally:
        spark.conf.unset(key)
    assert len(files(f"{path}/k=7")) > 3
    assert spark.read.parquet(path).count() == 200_000


def test_columns_in_order(spark, people, tmp_path):
    path = file_sink(people, f"{tmp_path}/out", "parquet", columns=["grp", "id"])
    assert spark.read.parquet(path).columns == ["grp", "id"]


def test_rows_per_file(spark, tmp_path):
    path = file_sink(spark.range(0, 1000, 1, 1), f"{tmp_path}/out", "parquet", max_rows_per_file=300)
    assert len(files(path)) == 4


def test_run_stamps(spark, tmp_path):
    base = f"{tmp_path}/out"
    assert latest_run(spark, base) is None
    for day in (2, 1):
        file_sink(spark.range(day), base, "parquet", run_stamp="%Y%m%d", now=datetime(2024, 5, day))
    os.makedirs(f"{base}/run=20991231")  # unfinished: no _SUCCESS
    assert latest_run(spark, base).endswith("run=20240502")
    assert spark.read.parquet(latest_run(spark, base)).count() == 2


def test_staged_write_replaces_only_when_done(spark, rows, tmp_path):
    path, tmp = f"{tmp_path}/deep/er/out", f"{tmp_path}/tmp"
    file_sink(spark.range(5), path, "parquet", tmp_path=tmp)
    with pytest.raises(FileExistsError):
        file_sink(spark.range(6), path, "parquet", tmp_path=tmp)
    assert file_sink(spark.range(6), path, "parquet", tmp_path=tmp, mode="ignore") == path
    assert spark.read.parquet(path).count() == 5

    failing = spark.range(10).withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        file_sink(failing, path, "parquet", tmp_path=tmp, mode="overwrite")
    assert rows(spark.read.parquet(path)) == [(i,) for i in range(5)]
    assert os.listdir(tmp) == []

    file_sink(spark.range(7), path, "parquet", transaction=True, mode="overwrite")
    assert spark.read.parquet(path).count() == 7
    assert os.listdir(os.path.dirname(path)) == ["out"]
    with pytest.raises(ValueError, match="append"):
        file_sink(spark.range(1), path, "parquet", transaction=True, mode="append")


def test_staged_write_may_read_what_it_replaces(spark, tmp_path):
    path = f"{tmp_path}/out"
    file_sink(spark.range(5), path, "parquet")
    file_sink(
        spark.read.parquet(path).where("id > 2"), path, "parquet", transaction=True,
        mode="overwrite",
    )
    assert spark.read.parquet(path).count() == 2


def test_run_stamps_must_sort(spark, tmp_path):
    for pattern in ("%d%m%Y", "%H%M%S", "%m-%Y", "%Y%m%d%I%M"):
        with pytest.raises(ValueError, match="sort"):
            file_sink(spark.range(1), f"{tmp_path}/x", "parquet", run_stamp=pattern)
    for pattern in ("%Y%m%d%H%M%S", "%Y-%m-%d", "%Y/%j"):
        file_sink(spark.range(1), f"{tmp_path}/{hash(pattern)}", "parquet", run_stamp=pattern)


def test_a_failed_publish_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    from tidewharf.sinks import files

    def fails(*args):
        raise OSError("no")

    monkeypatch.setattr(files, "publish", fails)
    with pytest.raises(OSError):
        file_sink(spark.range(1), f"{tmp_path}/out", "parquet", transaction=True)
    assert os.listdir(tmp_path) == []
