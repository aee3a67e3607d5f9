"""Directories named by an expression, and back."""

import os

import pytest

from tidewharf.sinks import file_sink, read_directories
from tidewharf.sinks.directories import compiled

ODD = [None, "", "null", "%null", "%empty", "NULL", "a/b", "a%2Fb", "a b", "a+b", " a", "a ", ".", "..", ".a", "_a", "a_",
       "*", "?", "[x]", "{x}", "=", ",", "@", "~", "!", "\u00e9", "e\u0301", "ß", "😀", "\\", ":", "\"", "'", "\n", "#", "__HIVE",
       "year=1", "-", "%", "1", "01", "1.0", "${x}", "\t"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_any_values_come_back(spark, tmp_path, rows, fmt):
    df = spark.createDataFrame([(i, a, ODD[(i * 7) % len(ODD)]) for i, a in enumerate(ODD * 2)],
                               "id long, a string, b string")
    for i, template in enumerate(("${a}/x/${b}", "k=${a},${b}", "${b}/v-${a}")):
        path = file_sink(df, f"{tmp_path}/t{i}", fmt, directory=template)
        got = read_directories(spark, path, template, "id long", fmt)
        assert rows(got.select("id", "a", "b")) == rows(df)
    assert os.path.isdir(f"{tmp_path}/t0/%null/x")


def test_expressions_types_and_kept_columns(spark, tmp_path, rows):
    df = spark.range(40).selectExpr("id", "date_add(date'2024-01-30', cast(id AS int)) AS day", "id % 3 AS k")
    path = file_sink(df, f"{tmp_path}/t", "parquet", directory="${year}/${month}/k${k}",
                     directory_columns={"year": "year(day)", "month": "date_format(day, 'MM')"},
                     keep_partition_columns=True)
    assert os.path.isdir(f"{tmp_path}/t/2024/01/k0")
    got = read_directories(spark, path, "${year}/${month}/k${k}", "id long, day date, k long",
                           types={"year": "int"})
    assert rows(got.select("id", "day", "k")) == rows(df)
    assert dict(got.dtypes)["year"] == "int" and {r.month for r in got.collect()} == {"01", "02", "03"}


def test_only_some_directories_are_opened(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, ODD[i]) for i in range(len(ODD))], "id long, a string")
    path = file_sink(df, f"{tmp_path}/t", "parquet", directory="${a}")
    for i, value in enumerate(ODD):
        got = read_directories(spark, path, "${a}", "id long", only={"a": value})
        assert [tuple(r) for r in got.collect()] == [(i, value)]
        assert len(got.inputFiles()) == 1
    assert read_directories(spark, path, "${a}", "id long", only={"a": "missing"}).collect() == []
    with pytest.raises(ValueError, match="has no b"):
        read_directories(spark, path, "${a}", "id long", only={"b": 1})


def test_replaced_as_a_whole(spark, tmp_path):
    def put(rows, **options):
        return file_sink(spark.createDataFrame(rows, "id long, a string"), f"{tmp_path}/t", "parquet",
                         directory="${a}", **options)

    path = put([(1, "x"), (2, "y")])
    with pytest.raises(FileExistsError):
        put([(3, "x")])
    put([(3, "x")], mode="ignore")
    bad = spark.range(4).selectExpr("IF(id = 3, raise_error('stopped'), id) AS id", "'x' AS a")
    with pytest.raises(Exception, match="stopped"):
        file_sink(bad, path, "parquet", directory="${a}", mode="overwrite")
    assert sorted(r.id for r in read_directories(spark, path, "${a}", "id long").collect()) == [1, 2]
    put([(3, "z")], mode="overwrite")
    assert [tuple(r) for r in read_directories(spark, path, "${a}", "id long").collect()] == [(3, "z")]
    assert sorted(os.listdir(tmp_path)) == ["t"]
    put([], mode="overwrite")
    assert read_directories(spark, path, "${a}", "id long").collect() == []


def test_bad_expressions(spark, tmp_path):
    for template in ("", "plain", "${a}${b}", "${a}-${b}", "${a}//${b}", "${a}/${a}", "_x${a}", "a b${a}", "${a}/.x"):
        with pytest.raises(ValueError):
            compiled(template)
    df = spark.range(1)
    with pytest.raises(ValueError, match="no column"):
        file_sink(df, f"{tmp_path}/t", directory="${a}")
    with pytest.raises(ValueError, match="either"):
        file_sink(df, f"{tmp_path}/t", directory="${id}", partition_by=["id"])
    with pytest.raises(ValueError, match="append"):
        file_sink(df, f"{tmp_path}/t", directory="${id}", mode="append")
