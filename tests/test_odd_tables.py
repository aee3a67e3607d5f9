"""Every workload oracle on tables that the driver's do not resemble."""

import duckdb
import pytest

import __spark_entry__ as driver
from compare import connect, differences
from tidewharf.workload import WORKLOAD

SOURCE = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def every(n, column):
    """Null in about one of ``n`` rows, by the row's number."""
    return f"case when rowid_ % {n} = 0 then null else {column} end as {column}"


ODD = {
    "nulls": {
        "customer": [every(11, "c_nationkey"), every(7, "c_mktsegment")],
        "supplier": [every(5, "s_nationkey")],
        "part": [every(9, "p_type"), every(8, "p_brand"), every(6, "p_size")],
        "orders": [every(10, "o_custkey"), every(9, "o_orderstatus"), every(7, "o_orderpriority")],
        "lineitem": [every(9, "l_orderkey"), every(8, "l_partkey"), every(7, "l_suppkey"),
                     every(10, "l_returnflag"), every(11, "l_linestatus")],
    },
    "shifted": {"part": ["cast(p_size - 25 as integer) as p_size"],
                "orders": ["case when o_custkey % 3 = 0 then 7 else o_custkey end as o_custkey"]},
    "no match": {"part": ["'NONE' as p_type", "'Brand#0' as p_brand"],
                 "lineitem": ["l_orderkey + 10000000 as l_orderkey", "cast(0 as double) as l_discount",
                              "cast(99 as double) as l_quantity"]},
}


@pytest.fixture(scope="module")
def odd_dirs(tmp_path_factory):
    dirs = {}
    for name, changes in ODD.items():
        folder = tmp_path_factory.mktemp("odd")
        con = duckdb.connect()
        for table in TABLES:
            replaced = ", ".join(changes.get(table, []))
            columns = "* exclude (rowid_)" + (f" replace ({replaced})" if replaced else "")
            con.execute(f"copy (select {columns} from (select *, row_number() over () as rowid_ "
                        f"from '{SOURCE}/{table}.parquet')) to '{folder}/{table}.parquet'")
        dirs[name] = str(folder)
    return dirs


@pytest.mark.parametrize("kind", list(ODD))
@pytest.mark.parametrize("name", sorted(WORKLOAD))
def test_query(spark, odd_dirs, kind, name):
    result = WORKLOAD[name](spark, odd_dirs[kind])
    assert differences(connect(odd_dirs[kind]), result, driver.oracle_sql()[name]) == []


def test_money_that_is_not_whole_cents_is_an_error(spark):
    from tidewharf.functions.exact import cents

    df = spark.createDataFrame([(10.005,)], "x double")
    with pytest.raises(Exception, match="not a whole number of cents"):
        df.select(cents("x")).collect()
    good = spark.createDataFrame([(0.07,), (1234567890.12,), (None,), (-3.3,)], "x double")
    assert [r[0] for r in good.select(cents("x")).collect()] == [7, 123456789012, None, -330]
