"""Points, polygons and grids: rasterizing, lookups, window joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of (x, y) arrays, by crossings to its right."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def crosses(edge: Column) -> Column:
        ax, ay, bx, by = edge["p"][0], edge["p"][1], edge["q"][0], edge["q"][1]
        at = ax + F.try_divide((y - ay) * (bx - ax), by - ay)
        return F.when((ay > y) != (by > y), (x < at).cast("int")).otherwise(0)

    return F.aggregate(F.transform(edges, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def rasterize(cells: DataFrame, polygons: DataFrame, label: str, order: str = "ord") -> DataFrame:
    """(r, c, label) of cells whose centre lies in a polygon; the last polygon wins.

    ``polygons`` has ``rings`` of pixel coordinates, the first one outer and the
    others holes.  Cells meet a polygon only where its box covers their rows.
    """
    outer = F.col("rings")[0]
    box = polygons.select(
        F.col(label).alias("_label"), F.col(order).alias("_ord"), "rings",
        F.array_min(F.transform(outer, lambda p: p[0])).alias("x0"), F.array_max(F.transform(outer, lambda p: p[0])).alias("x1"),
        F.array_min(F.transform(outer, lambda p: p[1])).alias("y0"), F.array_max(F.transform(outer, lambda p: p[1])).alias("y1"),
    )
    # An equality on the row lets Spark shuffle or broadcast instead of trying all pairs.
    rows = box.withColumn("r", F.explode(F.sequence(F.floor("y0"), F.ceil("y1"))))
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    met = cells.select("r", "c").join(rows, "r").filter(x.between(F.col("x0"), F.col("x1")))
    inside = in_ring(x, y, F.col("rings")[0]) & ~F.exists(F.slice("rings", 2, F.greatest(F.size("rings"), F.lit(1))), lambda ring: in_ring(x, y, ring))
    return met.filter(inside).groupBy("r", "c").agg(F.max_by("_label", "_ord").alias(label))


def to_cell(df: DataFrame, x: Column, y: Column, origin_x: float, origin_y: float, pixel: float) -> DataFrame:
    """Adds the row and column of map coordinates."""
    return df.withColumn("r", F.floor((F.lit(origin_y) - y) / pixel)).withColumn("c", F.floor((x - F.lit(origin_x)) / pixel))


def window_max(points: DataFrame, raster: DataFrame, value: str, key: str, reach: int = 1) -> DataFrame:
    """(key, value): the largest value within ``reach`` cells of each point; null off the raster."""
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    around = points.select(key, F.col("r").alias("_r"), F.col("c").alias("_c")).withColumn("_dr", steps).withColumn("_dc", steps)
    cells = around.select(key, (F.col("_r") + F.col("_dr")).alias("r"), (F.col("_c") + F.col("_dc")).alias("c"))
    return cells.join(raster.select("r", "c", value), ["r", "c"], "left").groupBy(key).agg(F.max(value).alias(value))


def _envelope(c: np.ndarray, height2: np.ndarray) -> np.ndarray:
    """Least of ``height2[j] + (c - c[j]) ** 2`` over all j, by the lower envelope of those parabolas."""
    sites = np.flatnonzero(np.isfinite(height2))
    if len(sites) == 0:
        return np.full(len(c), np.nan)
    at, high = c[sites].tolist(), height2[sites].tolist()
    hull, begins = [0], [-math.inf]
    for q in range(1, len(at)):
        while True:
            p = hull[-1]
            meets = (high[q] + at[q] ** 2 - high[p] - at[p] ** 2) / (2 * (at[q] - at[p]))
            if meets > begins[-1]:
                break
            hull.pop()
            begins.pop()
        hull.append(q)
        begins.append(meets)
    lowest = sites[np.array(hull)[np.searchsorted(begins, c, side="right") - 1]]
    return height2[lowest] + (c - c[lowest]) ** 2


#: Lines whose nearest cells are sought together, and steps to either side before a line is solved by itself.
LINES, STEPS = 32, 64


def _nearest_along(height2: np.ndarray) -> np.ndarray:
    """``_envelope`` of every line, infinite without sites: near sites by steps to either side, far ones by parabolas."""
    best = height2.copy()
    for k in range(1, min(STEPS, height2.shape[1] - 1) + 1):
        if not (best > k * k).any():
            return best
        np.minimum(best[:, k:], height2[:, :-k] + k * k, out=best[:, k:])
        np.minimum(best[:, :-k], height2[:, k:] + k * k, out=best[:, :-k])
    if height2.shape[1] - 1 > STEPS:
        c = np.arange(height2.shape[1], dtype=np.float64)
        for i in np.flatnonzero((best > STEPS * STEPS).any(axis=1) & np.isfinite(height2).any(axis=1)):
            best[i] = _envelope(c, height2[i])
    return best


def distances(cells: DataFrame, flags: dict[str, str], pixel: float) -> DataFrame:
    """Adds, for each (new, flag), the exact distance to the nearest flagged cell; null if there is none.

    First the nearest flagged cell of a cell's own column, by two windows; then, some lines
    at a time, the lower envelope of the parabolas that stand on these.  Work is
    in proportion to the raster, whatever the distances: both windows run from their
    line's end, as Spark begins a frame that ends there anew for each row.
    """
    column = Window.partitionBy("c")
    upto, onward = (column.orderBy(way).rowsBetween(Window.unboundedPreceding, 0) for way in (F.asc("r"), F.desc("r")))
    made = cells
    for new, flag in flags.items():
        own = F.when(F.col(flag), F.col("r"))
        made = made.withColumn(new, F.least(F.col("r") - F.last(own, True).over(upto), F.last(own, True).over(onward) - F.col("r")).cast("double"))
    names = made.columns

    def along(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy() for x in ("r", "c"))
        base, last = c.min(), r.min()
        held = np.full((r.max() - last + 1, c.max() - base + 1), np.inf)
        for new in flags:
            held[:] = np.inf
            held[r - last, c - base] = np.nan_to_num(table.column(new).to_numpy(zero_copy_only=False).astype(np.float64) ** 2, nan=np.inf)
            d = np.sqrt(_nearest_along(held)[r - last, c - base]) * pixel
            table = table.set_column(names.index(new), new, pa.array(np.where(np.isinf(d), np.nan, d), from_pandas=True))
        return table.drop_columns(["_lines"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return made.withColumn("_lines", F.floor(F.col("r") / LINES)).groupBy("_lines").applyInArrow(along, schema)


def ring_area(ring: Column) -> Column:
    """Area by the shoelace formula of a closed ring of (x, y) arrays."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less its holes."""
    areas = F.transform(rings, ring_area)
    return F.element_at(areas, 1) * 2 - F.aggregate(areas, F.lit(0.0), lambda a, v: a + v)
