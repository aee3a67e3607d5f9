"""Results that several steps read, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as they are now, in files of the shared scratch folder."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
