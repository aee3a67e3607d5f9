"""Running sums, the joins counted with them, and medians, against brute force."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewharf.operators import day_slices, median_by, rows_per_day, running_sum, with_totals
from tidewharf.sources.tables import SCHEMAS
from tidewharf.workload import WORKLOAD, joins
from tidewharf.workload.joins import range_join, theta_join
from tidewharf.workload.windows import running_total


def skewed_rows(n=3000, seed=1):
    """A third of the rows on key 7, some on a null key, many equal times."""
    pick = random.Random(seed)
    keys = [7] * 10 + [None] * 3 + list(range(20, 37))
    return [(pick.choice(keys), pick.randrange(0, 200), i, pick.randrange(-5, 50)) for i in range(n)]


def expected_running(data, peers=False):
    out = []
    for key, at, row, _ in data:
        out.append((row, sum(
            v for k, t, r, v in data
            if k == key and (t <= at if peers else (t, r) <= (at, row))
        )))
    return sorted(out)


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_running_sum(spark, size):
    data = skewed_rows()
    df = spark.createDataFrame(data, "k int, at int, row int, v bigint").repartition(5)
    got = running_sum(df, ["k"], ["at", "row"], "v", slice_by=F.expr(f"at div {size}"), name="s")
    assert got.columns == ["k", "at", "row", "v", "s"]
    assert sorted((r.row, r.s) for r in got.collect()) == expected_running(data)


def test_running_sum_with_peers(spark):
    data = skewed_rows(1500, seed=2)
    df = spark.createDataFrame(data, "k int, at int, row int, v bigint")
    got = running_sum(
        df, ["k"], ["at"], "v", slice_by=F.expr("at div 10"), with_peers=True, name="s"
    )
    assert sorted((r.row, r.s) for r in got.collect()) == expected_running(data, peers=True)


@pytest.mark.parametrize("slices", [1, 7, 1000])
def test_totals_beside_rows(spark, rows, slices):
    """A third on one key; and 5,000 equally crowded keys."""
    for data in (skewed_rows(), [(i % 5000, 0, i, i % 7) for i in range(10_000)]):
        df = spark.createDataFrame(data, "k int, at int, row int, v bigint")
        got = with_totals(df, ["k"], ["row"], {"t": F.col("v"), "n": F.lit(1)}, slices=slices)
        sums, counts = {}, {}
        for k, _, _, v in data:
            sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
        assert rows(got.select("k", "at", "row", "v", "t", "n")) == sorted(
            ((k, at, row, v, sums[k], counts[k]) for k, at, row, v in data if k is not None),
            key=repr)


def test_a_crowded_key_is_many_tasks(spark):
    """No group that a task gets whole holds more than a slice of the key's rows."""
    df = spark.range(20_000).selectExpr("if(id % 3 > 0, 7, id) AS k", "id AS row", "id AS v")
    got = with_totals(df, ["k"], ["row"], {"t": F.col("v")}, slices=100)
    cut = got.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(100)))
    assert cut.groupBy("k", "slice").count().agg(F.max("count")).first()[0] < 13_334 / 50


def orders_dir(spark, tmp_path):
    """Orders of which a third belong to one customer, many on the same day."""
    pick = random.Random(3)
    start = datetime(1996, 1, 1)
    data = [
        (i, 7 if i % 3 == 0 else pick.randrange(100, 140), "F", pick.randrange(1, 9999) / 100,
         start + timedelta(days=pick.randrange(0, 400)), "1-URGENT")
        for i in range(900)
    ]
    spark.createDataFrame(data, SCHEMAS["orders"]).write.parquet(f"{tmp_path}/orders.parquet")
    return data


@pytest.mark.parametrize("slicing", [{}, {"rows_per_slice": 100}, {"rows_per_slice": 1}])
def test_range_join_counts_pairs(spark, tmp_path, slicing):
    data = orders_dir(spark, tmp_path)
    expected = {}
    for _, a_cust, _, _, a_day, _ in data:
        for _, b_cust, _, _, b_day, _ in data:
            if a_cust == b_cust and a_day < b_day <= a_day + timedelta(days=30):
                expected[a_cust] = expected.get(a_cust, 0) + 1
    got = range_join(spark, str(tmp_path), **slicing)
    assert {r.o_custkey: r.n_pairs for r in got.collect()} == expected


SLICINGS = [{}, {"rows_per_slice": 100}, {"rows_per_slice": 1}]


@pytest.mark.parametrize("slicing", [
    *SLICINGS, {"keys_per_slice": 50, "rows_per_slice": 2}, {"keys_per_slice": 50}])
def test_running_total_per_order(spark, tmp_path, slicing):
    data = orders_dir(spark, tmp_path)
    expected = {}
    for key, cust, _, _, day, _ in data:
        cents = sum(
            round(price * 100) for k, c, _, price, d, _ in data
            if c == cust and (d, k) <= (day, key)
        )
        expected[key] = cents / 100
    got = running_total(spark, str(tmp_path), **slicing)
    assert {r.o_orderkey: r.spent for r in got.collect()} == expected


def test_theta_join_counts_pairs(spark, tmp_path):
    pick = random.Random(4)
    data = [
        (i, "part", f"Brand#{pick.randrange(4)}", "PROMO",
         pick.choice([-2**31, -25, -1, 0, 1, 7, 8, 8, 8, 50, 63, 64, 2**31 - 1]), pick.randrange(9000, 20000, 250) / 100)
        for i in range(300)
    ]
    spark.createDataFrame(data, SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    expected = {}
    for a in data:
        n = sum(1 for b in data if a[4] < b[4] and a[5] > b[5] + 50)
        if n:
            expected[a[2]] = expected.get(a[2], 0) + n
    got = theta_join(spark, str(tmp_path))
    assert {r.p_brand: r.n_pairs for r in got.collect()} == expected


def test_median(spark):
    data = [("odd", v) for v in (9, 1, 4000, 4, 4)] + [("even", v) for v in (10, 20, 2030, 9999)]
    got = median_by(
        spark.createDataFrame(data, "k string, v bigint"), "k", "v", slice_by=F.expr("v div 1000")
    )
    assert {r.k: r.p50 for r in got.collect()} == {
        "odd": 4.0, "even": statistics.median([10, 20, 2030, 9999])
    }


def test_hot_order_needs_no_pairs(spark, tmp_path):
    """One order with a third of the lines; the oracle's self join is checked by hand."""
    lines = [
        (0 if i % 3 == 0 else i, 1, i % 2 if i % 3 == 0 else 5, 1, 1.0, 10.0, 0.0, 0.0,
         "N", "F" if i % 2 else "O", datetime(1996, 1, 1))
        for i in range(600)
    ]
    spark.createDataFrame(lines, SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = WORKLOAD["exists_not_exists"](spark, str(tmp_path)).first()
    assert (got.n_orders, got.revenue) == (1, 10.0 * sum(1 for i in range(0, 600, 3) if i % 2))


@pytest.mark.parametrize(
    "name", ["above_group_average", "subquery_having", "low_revenue_join"]
)
def test_slices_do_not_change_results(spark, rows, sf_dir, name):
    query = joins.QUERIES[name]
    assert rows(query(spark, sf_dir, slices=3)) == rows(query(spark, sf_dir))


def test_day_slices_hold_their_share(spark):
    """A crowded key, a crowded day, empty years between and rows without a time."""
    start = datetime(1970, 1, 1)
    pick = random.Random(5)
    days = [pick.choice([-3, 7, 7, 7, 8, 9, 500, 501, 3650]) for _ in range(3000)]
    data = [(i, 1 if i % 3 else i, start + timedelta(days=d, seconds=pick.randrange(86400)), 1)
            for i, d in enumerate(days)] + [(5000 + i, 1, None, 1) for i in range(5)]
    df = spark.createDataFrame(data, "row int, k int, at timestamp_ntz, v bigint")
    finer = F.date_trunc("hour", "at")
    slices = day_slices(rows_per_day(df, "at"), "at", finer, rows_per_slice=400)
    held = df.withColumn("s", slices).groupBy("s").count().orderBy("s").collect()
    assert max(r["count"] for r in held) <= 400 and len(held) > 24
    got = running_sum(df, ["k"], ["at", "row"], "v", slice_by=slices, name="s")
    plain = running_sum(df, ["k"], ["at", "row"], "v", slice_by=None, name="s")
    assert sorted((r.row, r.s) for r in got.collect()) == sorted((r.row, r.s) for r in plain.collect())
    assert day_slices({}, "at", finer) is None
