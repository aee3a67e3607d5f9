"""Window functions, mostly over sums that are already small.

Where a window has few partitions it runs after an aggregation whose row count
is bounded by names and dates, not by the fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.exact import (
    CENTS, REVENUE, amount, cents, merge, partial, regroup, revenue_units,
)
from ..operators import day_slices, rows_per_day, running_sum
from ..sources import load
from .common import bigint


def _brand_units(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    by_part = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(*partial(revenue_units(), "revenue"))
    )
    return (
        by_part.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(*by)
        .agg(*regroup("revenue"))
    )


def _brand_revenue(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return _brand_units(spark, sf_dir, *by).select(*by, amount("revenue", REVENUE).alias("revenue"))


def top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best brands of each part type."""
    best = Window.partitionBy("p_type").orderBy(F.desc("revenue"))
    return (
        _brand_revenue(spark, sf_dir, "p_type", "p_brand")
        .withColumn("place", F.rank().over(best))
        .where("place <= 3")
        .withColumn("place", bigint(F.col("place")))
    )


def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's share of its type's revenue."""
    of_type = Window.partitionBy("p_type")
    return _brand_units(spark, sf_dir, "p_type", "p_brand").select(
        "p_type",
        "p_brand",
        amount("revenue", REVENUE).alias("revenue"),
        (amount("revenue", REVENUE) / merge("revenue", REVENUE, over=of_type)).alias("share"),
    )


def lag_lead_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals per priority beside the previous, next and year's mean."""
    months = (
        load(spark, sf_dir, "orders")
        .groupBy(
            "o_orderpriority",
            bigint(F.year("o_orderdate")).alias("order_year"),
            bigint(F.month("o_orderdate")).alias("order_month"),
        )
        .agg(*partial(cents("o_totalprice"), "total"))
    )
    total = amount("total", CENTS)
    in_order = Window.partitionBy("o_orderpriority").orderBy("order_year", "order_month")
    of_year = Window.partitionBy("o_orderpriority", "order_year")
    return months.select(
        "o_orderpriority",
        "order_year",
        "order_month",
        total.alias("total"),
        F.lag(total).over(in_order).alias("previous"),
        F.lead(total).over(in_order).alias("next"),
        (merge("total", CENTS, over=of_year) / F.count(F.lit(1)).over(of_year)).alias("year_mean"),
    )


# Order keys in one slice of the orders of one time.
KEYS_PER_SLICE = 1 << 22


def _hour_and_key(time: str, key: str, keys_per_slice: int) -> Column:
    """Slices in order of time, then key: an hour, and what is on the hour by ranges of keys.

    Orders dated by the day are all on the hour, however many a day has.
    """
    hour = F.date_trunc("hour", time)
    on_the_hour = F.col(time) == hour
    return F.struct(
        hour.alias("hour"), (~on_the_hour).alias("later"),
        F.when(on_the_hour, F.floor(F.col(key) / keys_per_slice)).alias("keys"),
    )


def running_total(
    spark: SparkSession, sf_dir: str, *, keys_per_slice: int = KEYS_PER_SLICE, **slicing
) -> DataFrame:
    """Each customer's spend up to and including every order."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", cents("o_totalprice").alias("cents")
    )
    finer = _hour_and_key("o_orderdate", "o_orderkey", keys_per_slice)
    slices = day_slices(rows_per_day(orders, "o_orderdate"), "o_orderdate", finer, **slicing)
    return running_sum(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", slice_by=slices, name="spent",
    ).select(
        "o_custkey", "o_orderkey", (F.col("spent").cast("double") / F.lit(CENTS)).alias("spent")
    )


def best_worst_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best and ten worst brands side by side.

    Each end is a distributed top ten, so only ten rows are numbered in one task.
    """
    brands = _brand_revenue(spark, sf_dir, "p_brand")

    def end(order: list, brand: str, revenue: str) -> DataFrame:
        place = bigint(F.row_number().over(Window.orderBy(*order)))
        return brands.orderBy(*order).limit(10).select(
            place.alias("place"), F.col("p_brand").alias(brand), F.col("revenue").alias(revenue)
        )

    best = end([F.desc("revenue"), "p_brand"], "best_brand", "best_revenue")
    worst = end([F.asc("revenue"), "p_brand"], "worst_brand", "worst_revenue")
    return best.join(worst, "place")


def deviation_from_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters in which a priority's total is over 10 % off that priority's mean."""
    quarters = (
        load(spark, sf_dir, "orders")
        .groupBy(
            "o_orderpriority",
            bigint(F.year("o_orderdate")).alias("order_year"),
            bigint(F.quarter("o_orderdate")).alias("order_quarter"),
        )
        .agg(*partial(cents("o_totalprice"), "total"))
    )
    group = Window.partitionBy("o_orderpriority")
    return quarters.select(
        "o_orderpriority",
        "order_year",
        "order_quarter",
        amount("total", CENTS).alias("total"),
        (merge("total", CENTS, over=group) / F.count(F.lit(1)).over(group)).alias("mean"),
    ).where(F.abs(F.col("total") - F.col("mean")) > 0.1 * F.col("mean"))


QUERIES = {
    f.__name__: f
    for f in (
        top_n_per_group, share_of_group, lag_lead_month, running_total, best_worst_pair,
        deviation_from_avg,
    )
}
