"""Small column functions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


#: What infinities are held to.
LARGEST = 1.7976931348623157e308


def is_finite(x: Column) -> Column:
    """Whether x is a number, neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST))


def finite(x: Column) -> Column:
    """x, or 0 where it is null or NaN, or the largest number of its sign where it is infinite."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(-LARGEST)), F.lit(LARGEST))


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, constant beyond the ends."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(out)


def digitize(x: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are at or below x."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (x >= cut).cast("int")
    return out


def first_largest(values: Sequence[Column]) -> Column:
    """1-based place of the largest value, the first of equal ones."""
    row = F.array(*values)
    return F.array_position(row, F.array_max(row)).cast("int")


def lookup(x: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table."""
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(x == key, F.lit(value)).otherwise(out)
    return out


def mean_of(columns: Sequence[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / len(columns)
