"""Exact median per key, by counting values rather than collecting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .running import running_sum
from .slices import SLICES, with_totals


def median_by(
    df: DataFrame, key: str, value: str, *, slice_by: Column, slices: int = SLICES
) -> DataFrame:
    """The middle value per key (mean of the two middle ones if the count is even).

    Rows collapse to one count per distinct value before anything is shuffled, and
    the counts are then summed in value order. Null values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, [key], [value], "_n", slice_by=slice_by, name="_upto")
    lower = F.floor((F.col("_size") + 1) / 2)
    upper = F.floor(F.col("_size") / 2) + 1
    return (
        with_totals(ranked, [key], [value], {"_size": F.col("_n")}, slices=slices)
        .groupBy(key)
        .agg(
            F.min(F.when(F.col("_upto") >= lower, F.col(value))).alias("_low"),
            F.min(F.when(F.col("_upto") >= upper, F.col(value))).alias("_high"),
        )
        .select(key, ((F.col("_low") + F.col("_high")) / 2.0).alias("p50"))
    )
