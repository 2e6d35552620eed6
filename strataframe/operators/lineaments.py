"""Straight edges of relief: line filter, density, segments, rose."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .halos import Kernel, mean, raster_size, shifted_sum, slopes, steepness, with_kernels
from .neighbourhood import illumination, slope_and_aspect
from .selection import quantile_row
from .targets import connected, settled

ANGLES = 12


def kernel(length: int, angle: int) -> list[tuple[int, int]]:
    """Cells of a line of odd ``length`` through the middle, ``angle`` times 15 degrees from north."""
    strike, half = math.radians(angle * 180 / ANGLES), length // 2
    return sorted({(round(-t * math.cos(strike)), round(t * math.sin(strike))) for t in range(-half, half + 1)})


def edges(df: DataFrame, dem: str = "dem", pixel: float = 20.0, suns: tuple[int, ...] = (0, 45, 90, 135), share: float = 0.85, size: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``edge``: whether the shaded relief under any of the suns is among its steepest 15 percent.

    One shuffle by tile for slopes, one for the steepness of all shades.
    """
    size = size or raster_size(df)
    lit = slope_and_aspect(with_kernels(df, [slopes("dz_dx", "dz_dy", dem, pixel)], size))
    lit = lit.withColumns({f"_l{sun}": illumination(float(sun), 30.0) for sun in suns})
    names = [f"_s{sun}" for sun in suns]
    made = settled(with_kernels(lit, [steepness(f"_s{sun}", f"_l{sun}") for sun in suns], size))
    cuts = quantile_row(made, {f"{n}_cut": (F.col(n), share) for n in names})
    any_edge = F.lit(False)
    for n in names:
        any_edge = any_edge | F.coalesce(F.col(n) >= F.col(f"{n}_cut"), F.lit(False))
    return made.crossJoin(F.broadcast(cuts)).withColumn("edge", any_edge).select(*df.columns, "edge")


def line_filter(length: int, edge: str = "edge") -> Kernel:
    """``straight``, the share of a line's cells that are edges, and ``angle``, the first of the best of twelve."""
    lines = [kernel(length, angle) for angle in range(ANGLES)]
    reach = length // 2

    def make(a: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.nan_to_num(a)
        share = np.stack([np.round(shifted_sum(a, dict.fromkeys(line, 1.0), reach) / len(line), 9) for line in lines])
        best = share.max(axis=0)
        return best, np.where(best > 0, share.argmax(axis=0), np.nan)

    return Kernel(("straight", "angle"), edge, reach, make, mirrored=False)


def straightness(df: DataFrame, length: int, edge: str = "edge", size: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``straight`` (0 to 1) and ``angle`` by the line filter, as shifted sums on tiles.

    Beyond the raster there are no edges.  ``angle`` is null where no line holds one.
    """
    return with_kernels(df, [line_filter(length, edge)], size).withColumn("angle", F.col("angle").cast("int"))


def lines(df: DataFrame, length: int, dem: str = "dem", pixel: float = 20.0, least: float = 0.7, size: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``line`` (whether a cell is an edge on a straight line), ``straight`` and ``angle``."""
    size = size or raster_size(df)
    found = straightness(edges(df, dem, pixel, size=size), length, size=size)
    return found.withColumn("line", F.col("edge") & (F.col("straight") >= least)).drop("edge")


def density(df: DataFrame, flag: str, radius_cells: int, pixel: float, out: str, size: tuple[int, int] | None = None) -> DataFrame:
    """Adds the length of lines per area around each cell."""
    made = with_kernels(df.withColumn("_one", F.col(flag).cast("double")), [mean("_mean", "_one", 2 * radius_cells + 1)], size)
    return made.withColumn(out, F.col("_mean") * (1000.0 / pixel)).drop("_one", "_mean")


def segments(df: DataFrame, width: int, pixel: float = 20.0, straight: float = 0.7, least_m: float = 400.0) -> DataFrame:
    """(component, angle, strike, x1, y1, x2, y2, length_m) of connected straight cells of one angle."""
    cells = df.filter(F.col("straight") >= straight).select("r", "c", "angle")
    grouped = connected(cells, width, "angle")
    strike = F.radians(F.col("angle") * (180.0 / ANGLES))
    along = (F.col("c") + 0.5) * F.sin(strike) - (F.col("r") + 0.5) * F.cos(strike)
    ends = grouped.withColumn("_t", along).groupBy("component", "angle").agg(F.min("_t").alias("a"), F.max("_t").alias("b"), F.avg(F.col("c") + 0.5).alias("x"), F.avg(F.col("r") + 0.5).alias("y"))
    middle = F.col("x") * F.sin(strike) - F.col("y") * F.cos(strike)
    at = lambda t: [F.col("x") + (t - middle) * F.sin(strike), F.col("y") - (t - middle) * F.cos(strike)]
    (x1, y1), (x2, y2) = at(F.col("a")), at(F.col("b"))
    found = ends.select("component", "angle", F.degrees(strike).alias("strike"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((F.col("b") - F.col("a") + 1) * pixel).alias("length_m"))
    return found.filter(F.col("length_m") >= least_m)


def rose(lines: DataFrame) -> DataFrame:
    """(sector, km) of all twelve sectors of strike."""
    step = 180.0 / ANGLES
    sums = lines.groupBy((F.floor(F.col("strike") / step) % ANGLES).cast("int").alias("sector")).agg((F.sum("length_m") / 1000).alias("km"))
    sectors = F.broadcast(lines.sparkSession.range(ANGLES).select(F.col("id").cast("int").alias("sector")))
    return sectors.join(sums, "sector", "left").select("sector", F.coalesce("km", F.lit(0.0)).alias("km"))
