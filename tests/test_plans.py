"""What the plans must look like, whatever the data's size."""

import re

import pytest

from conftest import SF_DIR
from tidewharf.workload import WORKLOAD


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(WORKLOAD))
def test_no_pairwise_joins_and_no_python(spark, no_broadcast, name):
    text = plan(WORKLOAD[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
        assert operator not in text


@pytest.mark.parametrize("name,shuffles", [
    ("exists_not_exists", 2), ("year_over_year", 1), ("readiness_rollup", 1), ("left_anti", 3),
    ("full_outer_overlap", 2), ("intersect_count", 2), ("cross_ratio", 3), ("star_brand_year", 5),
    ("month_pivot", 5), ("count_between", 4), ("ship_lag_bucket", 3), ("excess_discount", 3),
])
def test_number_of_shuffles(spark, no_broadcast, name, shuffles):
    text = plan(WORKLOAD[name](spark, SF_DIR))
    assert len(re.findall(r"Exchange (hashpartitioning|SinglePartition)", text)) == shuffles


@pytest.mark.parametrize("name,pushed", [
    ("star_brand_year", "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00"),
    ("star_brand_year", "EqualTo(p_type,PROMO)"),
    ("month_pivot", "LessThan(l_shipdate,1998-01-01T00:00"),
    ("union_channel_rollup", "In(l_returnflag, [N,R])"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    result = WORKLOAD[name](spark, SF_DIR)
    scans = result._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert pushed in scans


def test_scans_read_only_needed_columns(spark):
    text = plan(WORKLOAD["cross_ratio"](spark, SF_DIR))
    columns = [re.sub(r"#\d+L?", "", c) for c in re.findall(r"FileScan parquet \[(.*?)\]", text)]
    assert sorted(columns) == ["l_partkey,l_extendedprice,l_discount", "p_partkey,p_type"]


@pytest.mark.parametrize("name", [
    "above_group_average", "subquery_having", "low_revenue_join", "frequent_items_max",
    "range_join", "running_total",
])
def test_lines_are_planned_at_most_twice(spark, no_broadcast, name):
    text = plan(WORKLOAD[name](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", text)) <= 2


@pytest.mark.parametrize("name", sorted(WORKLOAD))
def test_queries_leave_the_settings_alone(spark, name):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    WORKLOAD[name](spark, SF_DIR)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


@pytest.mark.parametrize("name,table,scans", [
    ("running_total", "o_orderkey", 1), ("range_join", "o_custkey", 1), ("theta_join", "p_brand", 2),
    ("low_revenue_join", "l_suppkey", 2), ("frequent_items_max", "o_orderkey", 1),
    ("distinct_aggs", "l_partkey", 1),
])
def test_scans_of_the_fact_table(spark, no_broadcast, name, table, scans):
    text = plan(WORKLOAD[name](spark, SF_DIR))
    assert len(re.findall(rf"FileScan parquet \[[^\]]*{table}", text)) == scans
