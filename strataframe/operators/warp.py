"""Rasters between coordinate systems: UTM zones of either hemisphere and degrees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .grids import resampled

#: Pixels between exact points, and the error in source pixels up to which the ones between are interpolated.
STEP = 64
TOLERANCE = 0.05
#: Corners, centre and middles of the sides of a square, in halves of it.
POINTS = ((0, 0), (0, 2), (2, 0), (2, 2), (1, 1), (0, 1), (1, 0), (1, 2), (2, 1))


@dataclass(frozen=True)
class Grid:
    """A north-up grid: EPSG 326xx or 327xx in metres, 4326 in degrees; upper left corner and pixel size."""

    epsg: int
    left: float
    top: float
    pixel: float
    width: int
    height: int


def _zone(epsg: int) -> tuple[int, bool]:
    zone = epsg % 100
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG {epsg} is neither a UTM zone on WGS84 nor 4326")
    return zone, epsg // 100 == 327


def carried(x: np.ndarray, y: np.ndarray, epsg: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Map coordinates of one system in another one."""
    if epsg == other:
        return x, y
    if epsg != 4326:
        zone, south = _zone(epsg)
        x, y = geo.degrees_of(x, y, zone, south)
    if other != 4326:
        zone, south = _zone(other)
        x, y = geo.metres_of(x, y, zone, south)
    return x, y


def exact(df: DataFrame, made_for: Grid, other: Grid, r: str, c: str, row: str, col: str) -> DataFrame:
    """Adds where pixel coordinates (r, c) of one grid lie on another, as columns ``row`` and ``col``.

    The series run in numpy on batches: as columns each of their steps would be written out
    once for every place that uses it.
    """

    @F.pandas_udf("row double, col double")
    def moved(at_r: pd.Series, at_c: pd.Series) -> pd.DataFrame:
        x, y = made_for.left + at_c.to_numpy() * made_for.pixel, made_for.top - at_r.to_numpy() * made_for.pixel
        x, y = carried(x, y, made_for.epsg, other.epsg)
        return pd.DataFrame({"row": (other.top - y) / other.pixel, "col": (x - other.left) / other.pixel})

    at = df.withColumn("_at", moved(F.col(r).cast("double"), F.col(c).cast("double")))
    return at.withColumns({row: F.col("_at.row"), col: F.col("_at.col")}).drop("_at")


def located(spark: SparkSession, target: Grid, source: Grid, step: int = STEP, tolerance: float = TOLERANCE) -> DataFrame:
    """(r, c, row, col): every pixel of the target with the place of its centre on the source.

    Squares of ``step`` pixels are the rows that the work starts from.  Four corners, the centre and
    the middles of the sides of a square are carried over exactly; its pixels lie between the corners
    bilinearly.  Where one of those five points is off by more than half of ``tolerance`` pixels of the
    source, all pixels of the square are carried over exactly.
    """
    across, down = -(-target.width // step), -(-target.height // step)
    squares = spark.range(across * down).select((F.floor(F.col("id") / across) * step).alias("_r0"), (F.col("id") % across * step).alias("_c0"))
    for a, b in POINTS:
        point = squares.withColumns({"_pr": F.col("_r0") + step * a / 2, "_pc": F.col("_c0") + step * b / 2})
        squares = exact(point, target, source, "_pr", "_pc", f"_r{a}{b}", f"_c{a}{b}").drop("_pr", "_pc")

    def between(axis: str, u: Column | float, v: Column | float) -> Column:
        p = lambda k: F.col(f"_{axis}{k}")
        return (p("00") * (1 - u) + p("20") * u) * (1 - v) + (p("02") * (1 - u) + p("22") * u) * v

    off = [F.abs(between(axis, a / 2, b / 2) - F.col(f"_{axis}{a}{b}")) for axis in "rc" for a, b in POINTS[4:]]
    judged = squares.withColumn("_straight", F.greatest(*off) * 2 <= tolerance)
    steps = F.sequence(F.lit(0), F.lit(step - 1))
    spread = judged.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"r": F.col("_r0") + F.col("_i"), "c": F.col("_c0") + F.col("_j")}).filter((F.col("r") < target.height) & (F.col("c") < target.width))
    u, v = (F.col("_i") + 0.5) / step, (F.col("_j") + 0.5) / step
    straight = spread.filter("_straight").select("r", "c", between("r", u, v).alias("row"), between("c", u, v).alias("col"))
    bent = spread.filter("not _straight or _straight is null").select("r", "c", (F.col("r") + 0.5).alias("_pr"), (F.col("c") + 0.5).alias("_pc"))
    return straight.unionByName(exact(bent, target, source, "_pr", "_pc", "row", "col").drop("_pr", "_pc"))


def averaged(source: DataFrame, value: str, grid: Grid, target: Grid) -> DataFrame:
    """(r, c, value, n): mean of the source pixels whose centres fall into a target cell, and their number.

    Each pixel falls into one cell, so that means times numbers keep the sum of all that lies on the
    target.  Null and NaN are missing; cells without any value are left out.
    """
    there = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    cells = source.filter(there).select((F.col("r") + 0.5).alias("_pr"), (F.col("c") + 0.5).alias("_pc"), F.col(value).alias("_v"))
    put = exact(cells, grid, target, "_pr", "_pc", "_row", "_col").select(F.floor("_row").alias("r"), F.floor("_col").alias("c"), "_v")
    inside = F.col("r").between(0, target.height - 1) & F.col("c").between(0, target.width - 1)
    return put.filter(inside).groupBy("r", "c").agg(F.avg("_v").alias(value), F.count("_v").alias("n"))


def warped(source: DataFrame, value: str, grid: Grid, target: Grid, how: str = "bilinear", step: int = STEP, tolerance: float = TOLERANCE) -> DataFrame:
    """(r, c, value) of every pixel of the target grid; null where the source has none.

    ``how`` is 'nearest' (classes), 'bilinear', or 'average' for targets coarser than the source.
    Bilinear values near missing pixels are weighted means of those that are there.
    """
    if how == "average":
        cells = target.width * target.height
        every = source.sparkSession.range(cells).select(F.floor(F.col("id") / target.width).alias("r"), (F.col("id") % target.width).alias("c"))
        return every.join(averaged(source, value, grid, target).drop("n"), ["r", "c"], "left")
    there = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    places = located(source.sparkSession, target, grid, step, tolerance)
    return resampled(places, source.filter(there).select("r", "c", value), value, F.col("col"), F.col("row"), how).select("r", "c", value)
