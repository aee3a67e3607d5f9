"""Exact money sums at double speed.

Prices and discounts arrive as doubles with two decimals. Summing doubles gives
a last digit that depends on task order, and summing decimals costs about seven
times as much. So each value becomes a whole number of cents, and the sum is
kept as two bigint halves (the value above and below 2**20). Both halves are
plain long sums inside whole-stage codegen, they merge across tasks in any
order, and hundreds of billions of rows do not overflow them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec

_BITS = 20
_LOW = (1 << _BITS) - 1

CENTS = 100.0
REVENUE = 10_000.0


def cents(value: Column | str) -> Column:
    """A two-decimal double as whole cents; a value that is not whole cents is an error."""
    value = F.col(value) if isinstance(value, str) else value
    hundredfold = value * 100
    whole = F.rint(hundredfold)
    off = F.abs(hundredfold - whole) > 0.001 + 1e-12 * F.abs(whole)
    # Added rather than chosen between, and without the value in the message: less generated code.
    refuse = F.raise_error(F.lit("a value is not a whole number of cents")).cast("bigint")
    return whole.cast("bigint") + F.coalesce(F.when(off, refuse), F.lit(0).cast("bigint"))


def revenue_units() -> Column:
    """Line revenue, price * (1 - discount), in 1/10000 of the currency."""
    return cents("l_extendedprice") * (F.lit(100).cast("bigint") - cents("l_discount"))


def high(units: Column) -> Column:
    """The upper half of whole units, to be summed on its own."""
    return F.shiftright(units, _BITS)


def low(units: Column) -> Column:
    """The lower half of whole units."""
    return units.bitwiseAND(F.lit(_LOW))


def _join_halves(high: Column, low: Column, scale: float) -> Column:
    whole = high.cast("decimal(20,0)") * F.lit(1 << _BITS) + low
    return whole.cast("double") / F.lit(scale)


def total(units: Column, scale: float) -> Column:
    """Aggregate: the exact sum of whole units, as a double in currency."""
    return _join_halves(F.sum(high(units)), F.sum(low(units)), scale)


def partial(units: Column, name: str) -> list[Column]:
    """Aggregates for a first grouping; ``merge`` sums them again later."""
    return [
        F.sum(high(units)).alias(f"{name}_hi"),
        F.sum(low(units)).alias(f"{name}_lo"),
    ]


def regroup(name: str) -> list[Column]:
    """Aggregates that carry ``partial`` columns through a further grouping."""
    return [F.sum(f"{name}_hi").alias(f"{name}_hi"), F.sum(f"{name}_lo").alias(f"{name}_lo")]


def merge(
    name: str, scale: float, *, when: Column | None = None, over: WindowSpec | None = None
) -> Column:
    """Aggregate (or window): finish ``partial`` columns into a double in currency."""
    upper, lower = F.col(f"{name}_hi"), F.col(f"{name}_lo")
    if when is not None:
        upper, lower = F.when(when, upper), F.when(when, lower)
    upper, lower = F.sum(upper), F.sum(lower)
    if over is not None:
        upper, lower = upper.over(over), lower.over(over)
    return _join_halves(upper, lower, scale)


def amount(name: str, scale: float) -> Column:
    """Row expression: ``partial`` columns as a double in currency."""
    return _join_halves(F.col(f"{name}_hi"), F.col(f"{name}_lo"), scale)


# --- Second moments ---------------------------------------------------------------
#
# A square of whole units may not fit a bigint. With u = a * 2**26 + b the squares are
# a*a * 2**52 + a*b * 2**27 + b*b, and each of the three is summed in two halves.

_HALF = 26
_HALF_MASK = (1 << _HALF) - 1
_PRODUCTS = ("aa", "ab", "bb")


def moments(units: Column, name: str) -> list[Column]:
    """Aggregates of whole units up to 2**52: number, sum and sum of squares, exact in any order."""
    a, b = F.shiftright(units, _HALF), units.bitwiseAND(F.lit(_HALF_MASK))
    aggregates = [F.count(units).alias(f"{name}_n"), *partial(units, name)]
    for key, product in zip(_PRODUCTS, (a * a, a * b, b * b)):
        aggregates += [
            F.sum(F.shiftright(product, _HALF)).alias(f"{name}_{key}_hi"),
            F.sum(product.bitwiseAND(F.lit(_HALF_MASK))).alias(f"{name}_{key}_lo"),
        ]
    return aggregates


def _whole(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(38,0)")


def _units_sum(name: str) -> Column:
    return _whole(f"{name}_hi") * F.lit(1 << _BITS) + _whole(f"{name}_lo")


def _squares_sum(name: str) -> Column:
    aa, ab, bb = (
        _whole(f"{name}_{key}_hi") * F.lit(1 << _HALF) + _whole(f"{name}_{key}_lo") for key in _PRODUCTS
    )
    return aa * F.lit(1 << 2 * _HALF) + ab * F.lit(1 << _HALF + 1) + bb


def _spread(name: str) -> Column:
    """n * (sum of squares) - (sum)**2, a whole number, as a double."""
    n, s1, s2 = _whole(f"{name}_n"), _units_sum(name), _squares_sum(name)
    exact = F.try_subtract(F.try_multiply(n, s2), F.try_multiply(s1, s1)).cast("double")
    # Beyond 38 digits the whole sums are combined as doubles.
    return F.coalesce(exact, n.cast("double") * s2.cast("double") - s1.cast("double") * s1.cast("double"))


def stddev_samp(name: str, scale: float) -> Column:
    """Row expression over ``moments``: the sample standard deviation, null of a single value."""
    n = F.col(f"{name}_n")
    return F.sqrt(_spread(name) / n / F.nullif(n - 1, F.lit(0))) / F.lit(scale)


def variation(name: str) -> Column:
    """Row expression over ``moments``: standard deviation over mean; null if the mean is 0."""
    n, s1 = F.col(f"{name}_n"), _units_sum(name).cast("double")
    return F.sqrt(_spread(name) * n / F.nullif(n - 1, F.lit(0))) / F.nullif(s1, F.lit(0.0))
