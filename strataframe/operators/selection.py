"""Exact order statistics by distributed selection.

Every wanted rank has an interval of values that holds it, at first the whole range.
A pass counts the values of all intervals in bins, with the least and the largest
value of each; the bin that holds the rank is the next interval.  Only bins meet in
a reducer, and a column's passes end when its interval is one value.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .targets import settled

#: Bins of an interval in one pass.
BINS = 4096
_LARGEST = 1.7976931348623157e308


@dataclass
class _Wanted:
    """A rank (from 0) among the values of an interval, the first of which is not before ``low``."""

    column: str
    rank: int
    low: float
    high: float


def _ends(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """(n, n_low, n_high, low, high) of each column: values, infinite ones below, infinite ones and NaN above, finite range."""
    aggs = []
    for c in columns:
        finite = F.abs(F.col(c)) <= F.lit(_LARGEST)
        above = F.isnan(c) | (F.col(c) > F.lit(_LARGEST))
        aggs += [F.count(c), F.count_if(F.col(c) < F.lit(-_LARGEST)), F.count_if(above), F.min(F.when(finite, F.col(c))), F.max(F.when(finite, F.col(c)))]
    row = df.agg(*aggs).first()
    return {c: tuple(row[5 * i : 5 * i + 5]) for i, c in enumerate(columns)}


def _bin(value: Column, low: float, high: float) -> Column:
    if math.isinf(high - low):
        share = (value / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    else:
        share = (value - F.lit(low)) / F.lit(high - low)
    return F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")


def _pass(df: DataFrame, intervals: list[tuple[str, float, float]]) -> list[dict[int, tuple[int, float, float]]]:
    """Of each interval (column, low, high) the bins: how many values, the least, the largest."""
    cells = [F.when(F.col(c).between(F.lit(a), F.lit(b)), F.struct(F.lit(i).alias("i"), _bin(F.col(c), a, b).alias("bin"), F.col(c).alias("v"))) for i, (c, a, b) in enumerate(intervals)]
    inside = F.lit(False)
    for c, a, b in intervals:
        inside = inside | F.col(c).between(F.lit(a), F.lit(b))
    rows = df.filter(inside).select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
    found: list[dict[int, tuple[int, float, float]]] = [{} for _ in intervals]
    for row in rows.groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():  # BINS rows an interval
        found[row.i][row["bin"]] = (row.n, row.a, row.b)
    return found


def values_at(df: DataFrame, ranks: dict[str, Callable[[int], list[int]]]) -> dict[str, tuple[int, dict[int, float]]]:
    """(n, value at each rank) of the values of each column, in ascending order, null ones left out.

    ``ranks`` gives the ranks, from 0, for a number of values.  NaN comes last, as
    in a sort.  ``df`` is read once for each pass: settle it if it is costly.
    """
    ends = _ends(df, list(ranks))
    out: dict[str, tuple[int, dict[int, float]]] = {}
    open_: list[tuple[_Wanted, int]] = []
    for c, which in ranks.items():
        n, n_low, n_high, low, high = ends[c]
        out[c] = n, {}
        for k in sorted(set(which(n))) if n else []:
            if k < n_low:
                out[c][1][k] = -math.inf
            elif k >= n - n_high:
                out[c][1][k] = math.nan
            else:
                open_.append((_Wanted(c, k - n_low, low, high), k))
    while open_:
        for w, k in open_:
            if w.low == w.high:
                out[w.column][1][k] = w.low
        open_ = [(w, k) for w, k in open_ if w.low < w.high]
        if not open_:
            break
        intervals = sorted({(w.column, w.low, w.high) for w, _ in open_})
        bins = dict(zip(intervals, _pass(df, intervals), strict=True))
        for w, _ in open_:
            for _, (n, low, high) in sorted(bins[w.column, w.low, w.high].items()):
                if w.rank < n:
                    w.low, w.high = low, high
                    break
                w.rank -= n
    return out


def quantiles(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, between neighbours by their distance; null without values."""
    places = lambda n, p: (math.floor((n - 1) * p), math.ceil((n - 1) * p))
    found = values_at(df, {c: (lambda n, ps=ps: [k for p in ps for k in places(n, p)]) for c, ps in shares.items()})

    def at(c: str, p: float) -> float | None:
        n, values = found[c]
        if not n:
            return None
        (a, b), place = places(n, p), (n - 1) * p
        low, high = values[a], values[b]
        return low if a == b or low == high else (b - place) * low + (place - a) * high

    return {c: [at(c, p) for p in ps] for c, ps in shares.items()}


def quantile_row(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with the exact quantile of each (column, share)."""
    names = {k: f"_{i}" for i, k in enumerate(wanted)}
    values = settled(df.select(*[v.cast("double").alias(names[k]) for k, (v, _) in wanted.items()]))
    found = quantiles(values, {names[k]: [p] for k, (_, p) in wanted.items()})
    return df.sparkSession.createDataFrame([tuple(found[names[k]][0] for k in wanted)], ", ".join(f"`{k}` double" for k in wanted))


def robust_row(df: DataFrame, columns: dict[str, Column], floor: float, spread: float = 1.4826) -> DataFrame:
    """One row of ``{name}_median`` (0 without values) and ``{name}_scale``: ``spread`` times the median deviation, floored."""
    names = {k: f"_{i}" for i, k in enumerate(columns)}
    values = settled(df.select(*[v.cast("double").alias(names[k]) for k, v in columns.items()]))
    middle = {k: x[0] if x[0] is not None else 0.0 for k, x in quantiles(values, {n: [0.5] for n in names.values()}).items()}
    off = quantiles(values.select(*[F.abs(F.col(n) - F.lit(middle[n])).alias(n) for n in names.values()]), {n: [0.5] for n in names.values()})
    row = [x for k in columns for x in (middle[names[k]], max(floor, off[names[k]][0] * spread if off[names[k]][0] is not None else 1.0))]
    return df.sparkSession.createDataFrame([tuple(map(float, row))], ", ".join(f"`{k}_median` double, `{k}_scale` double" for k in columns))
