"""Exact distinct counts of several columns in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

_BITS = 64


def _signed(bits: int) -> int:
    return bits - (1 << _BITS) if bits >> (_BITS - 1) else bits


#: For each binary digit of a position in a block, the positions that have it.
_WITH_DIGIT = [
    _signed(sum(1 << at for at in range(_BITS) if at >> digit & 1)) for digit in range(6)
]


def distinct_numbers(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column],
) -> DataFrame:
    """Per ``keys`` how many different whole numbers each of ``values`` takes, and their sum.

    For a value called ``x`` the columns are ``x_count`` and, in two halves as for money,
    ``x_hi`` and ``x_lo``. Numbers are marked in blocks of 64: a group is a key, a value and a block,
    and its aggregate is one bigint that tasks combine by ``or``. So a column of dense numbers
    is shuffled as one row for up to 64 of them, and neither rows nor numbers are
    gathered. Nulls are no numbers; a key whose values are all null counts 0 with null sums.
    (``bitmap_construct_agg`` keeps its bitmap in a binary, which only a sort aggregates.)
    """
    names = list(values)
    numbered = df.select(*keys, *[value.cast("bigint").alias(f"v{i}") for i, value in enumerate(values.values())])
    pairs = ", ".join(f"{i}, v{i}" for i in range(len(names)))
    marks = (
        numbered.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(names)}, {pairs}) AS (_which, _value)")
        .groupBy(*keys, "_which", F.shiftright("_value", 6).alias("_block"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_value & 63 AS int))")).alias("_marks"))
        .withColumn("_n", F.bit_count("_marks").cast("bigint"))
    )
    places = F.lit(0).cast("bigint")
    for digit, having in enumerate(_WITH_DIGIT):
        places += F.bit_count(F.col("_marks").bitwiseAND(F.lit(having).cast("bigint"))) * (1 << digit)
    # A block's number of up to 2**57 times 64 numbers is kept in two halves before it is multiplied.
    low = (F.col("_block").bitwiseAND(F.lit((1 << 14) - 1)) * 64) * F.col("_n") + places
    high = F.shiftright("_block", 14) * F.col("_n")

    aggregates = []
    for i, name in enumerate(names):
        mine = F.col("_which") == i
        aggregates += [
            F.coalesce(F.sum(F.when(mine, F.col("_n"))), F.lit(0)).alias(f"{name}_count"),
            F.sum(F.when(mine, high)).alias(f"{name}_hi"),
            F.sum(F.when(mine, low)).alias(f"{name}_lo"),
        ]
    return marks.groupBy(*keys).agg(*aggregates)
