"""Second moments and distinct counts: the same digits whatever the partitions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewharf.functions.exact import moments, stddev_samp, variation
from tidewharf.operators import distinct_numbers
from tidewharf.workload import WORKLOAD

from conftest import SF_DIR


def spread(values, scale=100):
    n, s1, s2 = len(values), sum(values), sum(v * v for v in values)
    return Fraction(n * s2 - s1 * s1, n * (n - 1)) / scale**2


@pytest.mark.parametrize("low, high", [(0, 5000), (-9999, 9999), (10**14, 10**14 + 99), (-2**52, 2**52)])
def test_moments_as_fractions(spark, low, high):
    rng = random.Random(high)
    units = [rng.randint(low, high) for _ in range(500)]
    df = spark.createDataFrame([(u,) for u in units], "u long")
    digits = set()
    for partitions in (1, 8, 200):
        row = df.repartition(partitions).agg(*moments(F.col("u"), "x")).select(
            stddev_samp("x", 100.0).alias("s"), variation("x").alias("v")).first()
        digits.add(tuple(row))
    (s, v), = digits
    assert s == pytest.approx(math.sqrt(spread(units)), rel=1e-14)
    mean = Fraction(sum(units), len(units)) / 100
    assert v == pytest.approx(math.sqrt(spread(units)) / float(mean), rel=1e-14)


def test_moments_of_few_values(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (2, 5), (3, None), (4, -3), (4, 3)], "k int, u long")
    got = df.groupBy("k").agg(*moments(F.col("u"), "x")).select(
        "k", stddev_samp("x", 1.0).alias("s"), variation("x").alias("v")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [
        (1, None, None), (2, 0.0, 0.0), (3, None, None), (4, pytest.approx(math.sqrt(18)), None)]


def test_more_digits_than_decimals_hold(spark):
    df = spark.range(0, 1000).selectExpr("id * 4503599627 + 1000000007 AS u")
    row = df.crossJoin(spark.range(1)).agg(*moments(F.col("u"), "x")).withColumn(
        "x_n", F.col("x_n")).select(stddev_samp("x", 1.0)).first()
    units = [i * 4503599627 + 1000000007 for i in range(1000)]
    assert row[0] == pytest.approx(math.sqrt(spread(units, 1)), rel=1e-12)


@pytest.mark.parametrize("name", ["stddev_cov", "distinct_aggs"])
def test_same_digits_in_any_partitioning(spark, tmp_path, rows, name):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    results = set()
    for n in (1, 8, 200):
        lines.repartition(n).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        results.add(tuple(rows(WORKLOAD[name](spark, f"{tmp_path}/{n}"))))
    assert len(results) == 1


def test_distinct_numbers_as_sets(spark):
    rng = random.Random(3)
    edges = [0, -1, 1, 63, 64, -64, -65, 2**31, -2**31, 2**62, -2**62, 2**63 - 1, -2**63]
    data = [(rng.choice(["a", "b", None]), rng.choice([*edges, None, rng.randint(-200, 200)]),
             rng.choice([None, rng.randint(0, 10**6)])) for _ in range(3000)] + [("c", None, 7), ("c", None, 7)]
    df = spark.createDataFrame(data, "k string, x long, y long").repartition(9)
    got = distinct_numbers(df, ["k"], {"x": F.col("x"), "y": F.col("y")}).collect()
    for row in got:
        for name, at in (("x", 1), ("y", 2)):
            values = {d[at] for d in data if d[0] == row.k} - {None}
            assert row[f"{name}_count"] == len(values)
            if values:
                assert row[f"{name}_hi"] * 2**20 + row[f"{name}_lo"] == sum(values)
            else:
                assert row[f"{name}_hi"] is None
    assert {r.k for r in got} == {"a", "b", "c", None}
    assert distinct_numbers(df.limit(0), ["k"], {"x": F.col("x")}).collect() == []


def test_one_scan_and_no_expand(spark):
    plan = WORKLOAD["distinct_aggs"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("FileScan") == 1 and "SortAggregate" not in plan
