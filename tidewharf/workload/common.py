"""Column helpers shared by the workload queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import load


def bigint(column: Column) -> Column:
    return column.cast("bigint")


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def in_years(column: str, first: int, last: int) -> Column:
    """A range on the date itself, so that it reaches the Parquet scan."""
    start = F.lit(f"{first}-01-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{last + 1}-01-01 00:00:00").cast("timestamp_ntz")
    return (F.col(column) >= start) & (F.col(column) < end)


def in_year(column: str, year: int) -> Column:
    return in_years(column, year, year)


def customer_years(
    spark: SparkSession, sf_dir: str, years: tuple[int, ...], condition: Column | None = None
) -> DataFrame:
    """Customers with an order in one of ``years``, and a flag ``in_<year>`` for each.

    One scan and one grouping, where set operations on yearly sets would scan the
    orders once per year.
    """
    orders = load(spark, sf_dir, "orders")
    if condition is not None:
        orders = orders.where(condition)
    return (
        orders.where(in_years("o_orderdate", min(years), max(years)))
        .groupBy("o_custkey")
        .agg(*[F.bool_or(in_year("o_orderdate", y)).alias(f"in_{y}") for y in years])
    )
