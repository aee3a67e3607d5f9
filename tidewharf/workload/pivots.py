"""Conditional sums laid out as columns, date buckets and string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exact import CENTS, cents, merge, partial, total
from ..sources import load
from .common import bigint, in_year

DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def weekday_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals per priority, one column per weekday."""
    by_day = (
        load(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.dayofweek("o_orderdate").alias("day"))
        .agg(*partial(cents("o_totalprice"), "price"))
    )
    return by_day.groupBy("o_orderpriority").agg(
        *[
            F.coalesce(merge("price", CENTS, when=F.col("day") == i), F.lit(0.0)).alias(name)
            for i, name in enumerate(DAYS, start=1)
        ]
    )


def _nation_quantities(
    spark: SparkSession, sf_dir: str, lines: DataFrame, columns: dict[str, Column]
) -> DataFrame:
    """Quantity per supplier nation, one column per condition.

    Summed per supplier first: one row each, already placed for the join. A plain
    bigint has room for the quantities of 10**15 lines of a supplier.
    """
    quantity = cents("l_quantity")
    by_supplier = lines.groupBy("l_suppkey").agg(
        *[F.sum(F.when(condition, quantity)).alias(name) for name, condition in columns.items()]
    )
    suppliers = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return (
        by_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("n_name")
        .agg(*[F.coalesce(total(F.col(name), CENTS), F.lit(0.0)).alias(name) for name in columns])
    )


def month_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped in 1997 per supplier nation, one column per month."""
    lines = load(spark, sf_dir, "lineitem").where(in_year("l_shipdate", 1997))
    month = F.month("l_shipdate")
    return _nation_quantities(
        spark, sf_dir, lines, {name: month == i for i, name in enumerate(MONTHS, start=1)}
    )


def before_after_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped in the 30 days before and from 1998-06-01, per supplier nation."""
    first, pivot, last = (
        F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
        for day in ("1998-05-02", "1998-06-01", "1998-07-01")
    )
    shipped = F.col("l_shipdate")
    lines = load(spark, sf_dir, "lineitem").where(shipped.between(first, last))
    return _nation_quantities(
        spark, sf_dir, lines, {"qty_before": shipped < pivot, "qty_after": shipped >= pivot}
    )


def ship_lag_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per priority by days from order to shipment."""
    lag = F.datediff("l_shipdate", "o_orderdate")
    return (
        load(spark, sf_dir, "lineitem")
        .join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority")
        .agg(
            F.count_if(lag < 0).alias("before_order"),
            F.count_if(lag.between(0, 30)).alias("within_30"),
            F.count_if(lag.between(31, 365)).alias("within_365"),
            F.count_if(lag > 365).alias("later"),
        )
    )


def string_prefix_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name prefix, label, length and a LIKE test for every customer."""
    name = F.col("c_name")
    ending = name.like("%01") | name.like("%02") | name.like("%03") | name.like("%9")
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.substring("c_name", 1, 10).alias("prefix"),
        F.concat(
            F.coalesce(name, F.lit("")), F.lit(", "), F.coalesce("c_mktsegment", F.lit(""))
        ).alias("label"),
        bigint(F.length("c_name")).alias("name_length"),
        F.upper("c_mktsegment").alias("segment"),
        ending.alias("name_matches"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        weekday_pivot, month_pivot, before_after_date, ship_lag_bucket, string_prefix_concat,
    )
}
