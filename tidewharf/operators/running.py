"""A running sum whose largest group need not fit one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of all keys together in one slice; no task gets more of a key.
ROWS_PER_SLICE = 1 << 26
# Calendar units that are told apart.
_MOST_UNITS = 50_000
_EPOCH = date(1970, 1, 1)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    *,
    slice_by: Column | None,
    with_peers: bool = False,
    name: str = "running",
) -> DataFrame:
    """Sum of ``value`` over ``keys`` up to and including each row in ``order``.

    A plain window sends all rows of a key to one task. Here they are cut into
    slices that follow the order: ``slice_by`` must never fall as ``order`` rises,
    e.g. the hour of a time, or a struct of the day and a range of the next column. Each slice starts from what the earlier slices of its
    key add up to, which is one extra row at its front. So the rows are shuffled
    once, as in the plain window, and the slice totals beside them are one row per
    key and slice.

    Every key is sliced, whatever its size. ``None`` says that all rows together are one slice;
    then there is no earlier one and the plain window is the same. ``with_peers`` includes all rows equal in
    ``order`` to the current one; they must be in the same slice.
    """
    keys = list(keys)
    frame = (Window.unboundedPreceding, Window.currentRow)
    if slice_by is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        window = window.rangeBetween(*frame) if with_peers else window.rowsBetween(*frame)
        return df.withColumn(name, F.sum(value).over(window))
    sliced = df.withColumn("_slice", slice_by)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(value).alias(value))
        .withColumns({value: F.sum(value).over(earlier), "_start": F.lit(True)})
        .where(F.col(value).isNotNull())
    )
    window = Window.partitionBy(*keys, "_slice").orderBy(F.desc_nulls_last("_start"), *order)
    window = window.rangeBetween(*frame) if with_peers else window.rowsBetween(*frame)
    return (
        sliced.unionByName(starts, allowMissingColumns=True)
        .withColumn(name, F.sum(value).over(window))
        .where(F.col("_start").isNull())
        .drop("_slice", "_start")
    )


def rows_per_day(df: DataFrame, time: str) -> dict[date, int]:
    """How many rows each day has; one row a day comes to the driver."""
    days = df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {row["day"]: row["n"] for row in days if row["day"] is not None}


def day_slices(
    days: Mapping[date, int], time: str, finer: Column, rows_per_slice: int = ROWS_PER_SLICE,
) -> Column | None:
    """Slices for ``running_sum`` of about equal row counts: runs of whole days.

    ``days`` are the rows per day of all keys together, so a slice of a key cannot hold more
    than its share however crowded the key is, and sparse keys are not cut more finely than
    the rows as a whole are. A day with more rows than a slice may have is cut by ``finer``, which
    must not fall as the order rises. None if all days are one slice. Rows
    without a time come before all others.
    """
    if sum(days.values()) <= rows_per_slice:
        return None
    at = sorted((day - _EPOCH).days for day in days)
    unit = 1
    while (at[-1] // unit - at[0] // unit) >= _MOST_UNITS:
        unit *= 2
    counts: dict[int, int] = {}
    for day, n in days.items():
        key = (day - _EPOCH).days // unit
        counts[key] = counts.get(key, 0) + n
    first, codes, number, held = min(counts), [], 0, 0
    for key in range(first, max(counts) + 1):
        n = counts.get(key, 0)
        if held and held + n > rows_per_slice:
            number, held = number + 1, 0
        held += n
        codes.append(2 * number + (n > rows_per_slice))
    # A literal, as the optimizer folds it.
    table = F.split(F.lit(",".join(map(str, codes))), ",").cast("array<int>")
    day = F.floor(F.datediff(F.to_date(time), F.lit(_EPOCH)) / unit)
    code = F.get(table, (day - first).cast("int"))
    return F.struct(F.shiftright(code, 1).alias("days"), F.when(code % 2 == 1, finer).alias("finer"))
