"""Moving windows over a raster relation with columns ``r`` and ``c``.

All are separable: one pass along rows and one along columns, each a Window over
one line of the raster, so work is dealt out by line and no pixel is copied to
its neighbours.  ``reflect`` repeats the outer pixels, mirrored, beyond the edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mirrored(df: DataFrame, axis: str, reach: int) -> DataFrame:
    """Adds ghost pixels: the first and last ``reach`` of each line, mirrored.

    A line's length comes from a window over that line, which the moving window that
    follows needs to be in one place anyway: the raster is read and dealt out once.
    """
    other = "c" if axis == "r" else "r"
    sized = df.withColumn("_size", F.max(axis).over(Window.partitionBy(other)) + 1)
    places = F.array(F.lit(0).cast("long"), F.when(F.col(axis) < reach, -2 * F.col(axis) - 1), F.when(F.col(axis) >= F.col("_size") - reach, 2 * (F.col("_size") - F.col(axis)) - 1))
    ghost = sized.withColumn("_shift", F.explode(F.array_compact(places)))
    return ghost.withColumn("_ghost", F.col("_shift") != 0).withColumn(axis, F.col(axis) + F.col("_shift")).drop("_shift", "_size")


def _along(df: DataFrame, axis: str, reach: int, outs: dict[str, Column], make: Callable[[Column], Column]) -> DataFrame:
    other = "c" if axis == "r" else "r"
    line = Window.partitionBy(other).orderBy(axis).rangeBetween(-reach, reach)
    made = _mirrored(df, axis, reach)
    for name, value in outs.items():
        made = made.withColumn(name, make(value).over(line))
    return made.filter(~F.col("_ghost")).drop("_ghost")


def box(df: DataFrame, values: dict[str, str], size: int, how: str = "avg", first: str = "c") -> DataFrame:
    """Adds, for each (new, old) in ``values``, the mean, max or min of old in a square of odd ``size``.

    ``first`` is the axis of the first pass.  A box whose first pass runs along the
    axis of the last pass before it finds the raster dealt out already.
    """
    make = {"avg": F.avg, "max": F.max, "min": F.min}[how]
    reach = size // 2
    second = "r" if first == "c" else "c"
    across = _along(df, first, reach, {new: F.col(old) for new, old in values.items()}, make)
    return _along(across, second, reach, {new: F.col(new) for new in values}, make)


def gradient(df: DataFrame, value: str, pixel: float) -> DataFrame:
    """Adds ``dz_dx`` and ``dz_dy``: central differences, one-sided at the edges."""

    def slope(axis: str) -> Column:
        other = "c" if axis == "r" else "r"
        line = Window.partitionBy(other).orderBy(axis)
        before, after, own = F.lag(value).over(line), F.lead(value).over(line), F.col(value)
        return F.coalesce((after - before) / (2 * pixel), (after - own) / pixel, (own - before) / pixel, F.lit(0.0))

    return df.withColumn("dz_dx", slope("c")).withColumn("dz_dy", slope("r"))


def with_slope_and_aspect(df: DataFrame, dem: str = "dem", pixel: float = 20.0) -> DataFrame:
    """Adds ``slope`` and ``aspect`` in radians (aspect 0 faces north)."""
    return slope_and_aspect(gradient(df, dem, pixel))


def slope_and_aspect(df: DataFrame) -> DataFrame:
    """``slope`` and ``aspect`` in place of ``dz_dx`` and ``dz_dy``."""
    return df.withColumn("slope", F.atan(F.hypot("dz_dx", "dz_dy"))).withColumn("aspect", F.atan2(-F.col("dz_dx"), F.col("dz_dy"))).drop("dz_dx", "dz_dy")


def illumination(azimuth: float, elevation: float) -> Column:
    """Cosine of the sun's angle to the slope."""
    zenith = F.radians(F.lit(90.0 - elevation))
    return F.cos(zenith) * F.cos("slope") + F.sin(zenith) * F.sin("slope") * F.cos(F.radians(F.lit(azimuth)) - F.col("aspect"))


def sobel(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the magnitude of the 3 x 3 Sobel gradient, edges mirrored."""

    def pass_(frame: DataFrame, axis: str, smooth: dict[str, str], edge: dict[str, str]) -> DataFrame:
        other = "c" if axis == "r" else "r"
        line = Window.partitionBy(other).orderBy(axis)
        made = _mirrored(frame, axis, 1)
        for new, old in smooth.items():
            made = made.withColumn(new, F.lag(old).over(line) + 2 * F.col(old) + F.lead(old).over(line))
        for new, old in edge.items():
            made = made.withColumn(new, F.lead(old).over(line) - F.lag(old).over(line))
        return made.filter(~F.col("_ghost")).drop("_ghost")

    across = pass_(df, "c", {"_sx": value}, {"_ex": value})
    both = pass_(across, "r", {"_gx": "_ex"}, {"_gy": "_sx"})
    return both.withColumn(out, F.hypot("_gx", "_gy")).drop("_sx", "_ex", "_gx", "_gy")


def neighbours(df: DataFrame, columns: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """(r, c, dr, dc, ...) of the pixels around each place, for kernels that don't separate."""
    moves = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])).alias("m")
    spread = df.select((F.col("r")).alias("_r"), F.col("c").alias("_c"), *columns, moves)
    return spread.select((F.col("_r") - F.col("m.dr")).alias("r"), (F.col("_c") - F.col("m.dc")).alias("c"), F.col("m.dr").alias("dr"), F.col("m.dc").alias("dc"), *columns)


def dilate(df: DataFrame, flag: str, radius: int, out: str) -> DataFrame:
    """Adds whether a flagged pixel lies within ``radius`` steps up, down or sideways."""
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius]
    near = neighbours(df.filter(flag), [], offsets).select("r", "c").distinct().withColumn(out, F.lit(True))
    return df.join(near, ["r", "c"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def majority(df: DataFrame, label: str, size: int, out: str) -> DataFrame:
    """Adds the most frequent rock class (1 to 7) in a square, lowest id on ties; masks keep their label.

    One windowed mean for each class present is what the counts come from, so the
    edge is mirrored here too.
    """
    votes = {f"_v{k}": F.when(F.col(label) == k, 1.0).otherwise(0.0) for k in range(1, 8)}
    counted = df.withColumns(votes)
    counted = box(counted, {v: v for v in votes}, size)
    counted = counted.withColumns({v: F.round(F.col(v) * size * size) for v in votes})
    best = F.array_position(F.array(*votes), F.array_max(F.array(*votes))).cast("int")
    keep = (F.col(label) == 0) | (F.col(label) >= 250)
    return counted.withColumn(out, F.when(keep, F.col(label)).otherwise(best)).drop(*votes)


def inside_class(df: DataFrame, label: str, out: str) -> DataFrame:
    """Adds whether the four neighbours have the same label; beyond the edge counts as the same."""
    same = F.lit(True)
    for axis, other in (("r", "c"), ("c", "r")):
        line = Window.partitionBy(other).orderBy(axis)
        for move in (F.lag, F.lead):
            same = same & (F.coalesce(move(label).over(line), F.col(label)) == F.col(label))
    return df.withColumn(out, same)
