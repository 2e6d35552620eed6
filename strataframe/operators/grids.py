"""Tiles of a region, halos between them, crops, and rasters moved to another grid."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions import geo


def nested_bounds(rings: Column) -> Column:
    """(west, south, east, north) of rings of (x, y) arrays."""
    points = F.flatten(rings)
    ends = lambda pick, axis: pick(F.transform(points, lambda p: p[axis]))
    return F.struct(ends(F.array_min, 0).alias("west"), ends(F.array_min, 1).alias("south"), ends(F.array_max, 0).alias("east"), ends(F.array_max, 1).alias("north"))


def tile_grid(boxes: DataFrame, key: str, step: float) -> DataFrame:
    """(key, tile, left, bottom, right, top) of the square tiles that a box (west, south, east, north) touches.

    Tiles are counted from the box's upper left corner, snapped outwards to
    multiples of ``step``; ``tile`` is column and row of three digits.
    """
    ox, oy = F.floor(F.col("west") / step) * step, F.ceil(F.col("north") / step) * step
    sized = boxes.withColumns({"_ox": ox, "_oy": oy})
    counts = {"_tx": F.ceil((F.col("east") - F.col("_ox")) / step), "_ty": F.ceil((F.col("_oy") - F.col("south")) / step)}
    spread = sized.withColumns(counts).withColumn("_tx", F.explode(F.sequence(F.lit(0), F.col("_tx") - 1))).withColumn("_ty", F.explode(F.sequence(F.lit(0), F.col("_ty") - 1)))
    left, top = F.col("_ox") + F.col("_tx") * step, F.col("_oy") - F.col("_ty") * step
    name = F.concat(F.lpad(F.col("_tx").cast("string"), 3, "0"), F.lit("_"), F.lpad(F.col("_ty").cast("string"), 3, "0"))
    return spread.select(key, name.alias("tile"), left.alias("left"), (top - step).alias("bottom"), (left + step).alias("right"), top.alias("top"))


def footprint() -> Column:
    """Closed ring of a tile with left, bottom, right and top."""
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    return F.array(corner("left", "bottom"), corner("right", "bottom"), corner("right", "top"), corner("left", "top"), corner("left", "bottom"))


def with_halo(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each pixel under every tile (tr, tc) that it belongs to or borders within ``halo`` pixels.

    One shuffle by tile then gives all kernels no wider than the halo what they need.
    """
    reach = lambda axis: F.sequence(F.greatest(F.floor((F.col(axis) - halo) / tile), F.lit(0)), F.floor((F.col(axis) + halo) / tile))
    spread = df.withColumn("tr", F.explode(reach("r"))).withColumn("tc", F.explode(reach("c")))
    return spread.withColumn("inner", (F.col("tr") == F.floor(F.col("r") / tile)) & (F.col("tc") == F.floor(F.col("c") / tile)))


def crop(df: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """The pixels of a window, counted from its own corner."""
    inside = F.col("r").between(row, row + height - 1) & F.col("c").between(col, col + width - 1)
    return df.filter(inside).withColumns({"r": F.col("r") - row, "c": F.col("c") - col})


def resampled(target: DataFrame, source: DataFrame, value: str, x: Column, y: Column, how: str = "nearest") -> DataFrame:
    """Adds ``value`` of another raster at its pixel coordinates (x, y); null off that raster.

    The way goes from target to source: each target cell names the one cell it
    reads, or the four it lies between, so that the join is one of equal keys.
    """
    placed = target.withColumns({"_x": x - 0.5, "_y": y - 0.5})
    if how == "nearest":
        named = placed.withColumns({"_sr": F.floor(F.col("_y") + 0.5), "_sc": F.floor(F.col("_x") + 0.5)})
        cells = source.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), value)
        return named.join(cells, ["_sr", "_sc"], "left").drop("_x", "_y", "_sr", "_sc")
    if how != "bilinear":
        raise ValueError(f"how must be 'nearest' or 'bilinear', not {how!r}")
    base = placed.withColumns({"_r0": F.floor("_y"), "_c0": F.floor("_x")})
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    spread = base.withColumn("_m", F.explode(four))
    fy, fx = F.col("_y") - F.col("_r0"), F.col("_x") - F.col("_c0")
    share = F.when(F.col("_m.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_m.b") == 1, fx).otherwise(1 - fx)
    named = spread.withColumns({"_w": share, "_sr": F.col("_r0") + F.col("_m.a"), "_sc": F.col("_c0") + F.col("_m.b")}).filter("_w > 0")
    met = named.join(source.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).alias("_v")), ["_sr", "_sc"])
    sums = met.groupBy("r", "c").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t"))
    return target.join(sums, ["r", "c"], "left").withColumn(value, F.col("_s") / F.col("_t")).drop("_s", "_t")


@F.pandas_udf(StructType().add("x", DoubleType()).add("y", DoubleType()))
def _metres(lon: pd.Series, lat: pd.Series, zone: pd.Series) -> pd.DataFrame:
    x, y = geo.metres_of(lon.to_numpy(), lat.to_numpy(), zone.to_numpy())
    return pd.DataFrame({"x": x, "y": y})


@F.pandas_udf(StructType().add("lon", DoubleType()).add("lat", DoubleType()))
def _degrees(x: pd.Series, y: pd.Series, zone: pd.Series) -> pd.DataFrame:
    lon, lat = geo.degrees_of(x.to_numpy(), y.to_numpy(), zone.to_numpy())
    return pd.DataFrame({"lon": lon, "lat": lat})


def squares_for(boxes: DataFrame, key: str) -> DataFrame:
    """(key, square): the 100 km squares whose scenes may touch a box (west, south, east, north), each once.

    For each zone of a box, points of 12 by 12 tell the metres it spans; a scene is its square and
    9.8 km more to the east and south.  A square is named for the band of its centre and of half a
    degree to either side.  Northern hemisphere.
    """
    zone = lambda lon: (F.floor((F.col(lon) + 180) / 6) + 1).cast("long")
    zones = boxes.select(key, "west", "south", "east", "north", F.explode(F.sequence(zone("west"), zone("east"))).alias("zone"))
    low, high = F.greatest("west", F.col("zone") * 6 - 186), F.least("east", F.col("zone") * 6 - 180)
    steps = F.explode(F.sequence(F.lit(0), F.lit(11)))
    spread = zones.withColumn("_i", steps).withColumn("_j", steps)
    lon, lat = low + (high - low) * F.col("_i") / 11, F.col("south") + (F.col("north") - F.col("south")) * F.col("_j") / 11
    metres = spread.withColumn("_at", _metres(lon.cast("double"), lat.cast("double"), F.col("zone")))
    span = metres.groupBy(key, "zone").agg(F.min("_at.x").alias("x0"), F.max("_at.x").alias("x1"), F.min("_at.y").alias("y0"), F.max("_at.y").alias("y1"))
    hundred = lambda v: F.floor(v / 100000)
    across = span.filter(hundred(F.col("x1")) >= 1).withColumns({"_e0": F.greatest(hundred(F.col("x0") - 10000), F.lit(1)), "_e1": F.least(hundred(F.col("x1")), F.lit(8))}).filter("_e0 <= _e1")
    cells = across.withColumn("_e", F.explode(F.sequence("_e0", "_e1"))).withColumn("_n", F.explode(F.sequence(hundred(F.col("y0")), hundred(F.col("y1") + 10000))))
    centre = cells.select(key, "zone", (F.col("_e") * 100000.0 + 50000).alias("x"), (F.col("_n") * 100000.0 + 50000).alias("y"))
    placed = centre.withColumn("_at", _degrees("x", "y", "zone"))
    bands = placed.withColumn("_lat", F.explode(F.array(*[F.col("_at.lat") + d for d in (-0.5, 0.0, 0.5)]))).filter("_lat >= -80 and _lat < 84")
    return bands.select(key, geo.mgrs_square(F.col("zone"), F.col("x"), F.col("y"), F.col("_lat")).alias("square")).distinct()
