"""Gather rows by partition value before a partitioned write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def gathered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Few tasks per value, so few files per directory.

    Adaptive execution splits a value that is too large for one task. Where it is
    switched off nothing would, so the rows then stay where they are.
    """
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    return df.hint("rebalance", *columns) if columns and adaptive else df
