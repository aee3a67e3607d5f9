"""Totals per key beside every row, however many rows a key has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Pieces that the rows of a key are cut into. One task gets a piece, so a key with a
# third of 6e11 rows is 200 million rows a task.
SLICES = 1000
ROWS_PER_SLICE = 1_000_000


def slices_for(rows: int) -> int:
    """How many slices so many rows need, if they may all be of one key."""
    return min(1 + rows // ROWS_PER_SLICE, SLICES)


def with_totals(
    df: DataFrame,
    keys: Sequence[str],
    row_key: Sequence[str],
    sums: Mapping[str, Column],
    *,
    slices: int = SLICES,
) -> DataFrame:
    """Add to every row the sums (``sums``: new column and expression) over its keys.

    Every row falls in one of ``slices`` slices of its key, by the hash of ``row_key``.
    Rows are summed per key and slice, the slices of a key (at most ``slices`` rows) in a
    window, and the sums are joined back on key and slice. So a crowded key is as many
    small groups, nothing is copied or broadcast, and the plan is the same for any data.
    Rows with a null in ``keys`` are dropped, as by an inner join. Sums are null-safe as
    usual: null where every value is null.
    """
    keys = list(keys)
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    cut = present.withColumn("_slice", F.pmod(F.xxhash64(*row_key), F.lit(slices)))
    whole = Window.partitionBy(*keys)
    totals = (
        cut.groupBy(*keys, "_slice")
        .agg(*[F.sum(value).alias(name) for name, value in sums.items()])
        .withColumns({name: F.sum(name).over(whole) for name in sums})
    )
    return cut.join(totals, [*keys, "_slice"]).drop("_slice")
