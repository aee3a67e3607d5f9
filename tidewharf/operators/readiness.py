"""Ready/total per group, and whether every member is ready."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def readiness(df: DataFrame, keys: Sequence[str], ready: Column) -> DataFrame:
    """A member whose state is unknown (null) counts as not ready."""
    is_ready = F.coalesce(ready, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_if(is_ready).alias("ready"),
        F.count(F.lit(1)).alias("total"),
        F.bool_and(is_ready).alias("all_ready"),
    ).withColumn("ready_of_total", F.concat_ws("/", "ready", "total"))
