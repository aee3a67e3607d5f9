"""Rollups, cubes, distinct and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.exact import (
    CENTS, REVENUE, amount, cents, merge, moments, partial, regroup, revenue_units, total, variation,
)
from ..operators import distinct_numbers, readiness
from ..sources import load
from .common import bigint, count_rows


def union_channel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and (negative) returns, rolled up by channel and status.

    Both branches of the union are filters of one table, so it is read once.
    """
    sold = F.col("l_returnflag") == "N"
    return (
        load(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag").isin("N", "R"))
        .groupBy(F.when(sold, "sales").otherwise("returns").alias("channel"), "l_linestatus")
        .agg(*partial(F.when(sold, revenue_units()).otherwise(-revenue_units()), "amount"))
        .rollup("channel", "l_linestatus")
        .agg(merge("amount", REVENUE).alias("amount"))
    )


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "nation")
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )


def rollup_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average balance by region and nation; the rollup sees one row per nation."""
    return (
        load(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(*partial(cents("c_acctbal"), "balance"), count_rows("n"))
        .join(_nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .rollup("r_name", "n_name")
        .agg((merge("balance", CENTS) / F.sum("n")).alias("avg_balance"), F.sum("n").alias("n"))
    )


def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by every combination of status and priority."""
    return (
        load(spark, sf_dir, "orders")
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(count_rows("n"))
        .cube("o_orderstatus", "o_orderpriority")
        .agg(F.sum("n").alias("n_orders"))
    )


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment, by priority and in all."""
    segment, priority = F.col("c_mktsegment"), F.col("o_orderpriority")
    return (
        load(spark, sf_dir, "orders")
        .groupBy("o_custkey", "o_orderpriority")
        .agg(count_rows("n"), *partial(cents("o_totalprice"), "price"))
        .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.sum("n").alias("n"), *regroup("price"))
        .groupingSets([[segment], [priority], []], segment, priority)
        .agg(
            bigint(F.grouping("c_mktsegment")).alias("all_segments"),
            bigint(F.grouping("o_orderpriority")).alias("all_priorities"),
            F.sum("n").alias("n_orders"),
            merge("price", CENTS).alias("total_price"),
        )
    )


def rollup_rank_in_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by region and nation, ranked among the rows of the same parent."""
    level = bigint(F.grouping("r_name")) + bigint(F.grouping("n_name"))
    rolled = (
        load(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(*partial(cents("o_totalprice"), "spend"))
        .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(*regroup("spend"))
        .join(_nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .rollup("r_name", "n_name")
        .agg(level.alias("lochierarchy"), merge("spend", CENTS).alias("spend"))
    )
    parent = F.when(F.col("lochierarchy") == 0, F.col("r_name"))
    siblings = Window.partitionBy("lochierarchy", parent).orderBy(F.desc("spend"))
    return rolled.withColumn("rank_in_parent", bigint(F.rank().over(siblings)))


def distinct_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several distinct aggregates per return flag, from one scan."""
    found = distinct_numbers(
        load(spark, sf_dir, "lineitem"), ["l_returnflag"],
        {"part": F.col("l_partkey"), "supp": F.col("l_suppkey"), "qty": cents("l_quantity")},
    )
    return found.select(
        "l_returnflag",
        F.col("part_count").alias("n_parts"),
        F.col("supp_count").alias("n_suppliers"),
        (amount("qty", CENTS) / F.nullif("qty_count", F.lit(0))).alias("avg_distinct_qty"),
    )


def stddev_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose quantities vary by more than half their mean, from exact sums."""
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(*moments(cents("l_quantity"), "qty"))
        .select("l_suppkey", variation("qty").alias("variation"))
        .where("variation > 0.5")
    )


def bucket_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quantity bucket: mean price if it is large, else mean discount."""
    buckets = {"bucket_1_10": (1, 10), "bucket_11_30": (11, 30), "bucket_31_33": (31, 33)}

    def choose(low: int, high: int):
        inside = F.col("l_quantity").between(low, high)
        n = F.count_if(inside)
        return F.when(
            n > 5000, total(F.when(inside, cents("l_extendedprice")), CENTS) / n
        ).when(n > 0, total(F.when(inside, cents("l_discount")), CENTS) / n)

    return load(spark, sf_dir, "lineitem").agg(
        *[choose(low, high).alias(name) for name, (low, high) in buckets.items()]
    )


def spend_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers spent 0 to 500,000, 500,000 to 1,000,000, and so on."""
    return (
        load(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(*partial(cents("o_totalprice"), "spend"))
        .select(bigint(F.floor(amount("spend", CENTS) / 500_000)).alias("segment"))
        .groupBy("segment")
        .agg(count_rows("n_customers"))
    )


def readiness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders per customer: ready, total and whether all are."""
    return readiness(
        load(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F"
    )


QUERIES = {
    f.__name__: f
    for f in (
        union_channel_rollup, rollup_avg, cube_counts, grouping_sets, rollup_rank_in_parent,
        distinct_aggs, stddev_cov, bucket_scalar, spend_segments, readiness_rollup,
    )
}
