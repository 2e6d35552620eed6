"""Class maps as polygons: cell edges, followed within tiles and linked into rings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .halos import TILE, Tile, over_tiles
from .targets import connected, settled


#: For a side heading east, south, west or north: (rows, columns) ahead and to the left, (x, y) where it begins.
_AHEAD, _LEFT, _BEGIN = ((0, 1), (1, 0), (0, -1), (-1, 0)), ((-1, 0), (0, 1), (1, 0), (0, -1)), ((0, 0), (1, 0), (1, 1), (0, 1))
_PIECES = "component long, node long, next long, closed boolean, cross long, points array<array<double>>"


def _edges(here: Tile, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, column, side, and those of the edge after it) of the unit edges of a tile's cells.

    ``parts`` are components with one more cell on each side, -1 where there is none.  An edge lies
    between a cell and what isn't its component, the cell on its right.  Where two edges of
    a component begin at one corner the ring turns left, so that no ring passes a corner twice.
    """
    at = lambda step: parts[1 + step[0] : 1 + step[0] + here.height, 1 + step[1] : 1 + step[1] + here.width]
    own, found = at((0, 0)), []
    for d, (ahead, left) in enumerate(zip(_AHEAD, _LEFT, strict=True)):
        across = ahead[0] + left[0], ahead[1] + left[1]
        i, j = np.nonzero((own >= 0) & (at(left) != own))
        turns, goes_on = (at(across) == own)[i, j], (at(ahead) == own)[i, j]
        step = [np.where(turns, across[k], np.where(goes_on, ahead[k], 0)) for k in range(2)]
        found.append((i, j, np.full(len(i), d), i + step[0], j + step[1], np.where(turns, d - 1, np.where(goes_on, d, d + 1)) % 4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _heads(after: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each edge's chain begins and how many steps before it: at an edge that none of these leads to, on a ring at the lowest.

    ``after`` is the next edge, or their number where that one isn't here.
    """
    n = len(after)
    jump, best = np.append(after, n), np.append(key, np.iinfo(np.int64).max)
    seen = -1
    while True:
        # Chains that end and rings' lowest are found when twice as far a look finds no more of either.
        lower, on = np.minimum(best, best[jump]), jump[jump]
        ended = int((on == n).sum())
        if ended == seen and (lower == best).all():
            break
        jump, best, seen = on, lower, ended
    before = np.arange(n)
    inside = after < n
    before[after[inside]] = np.flatnonzero(inside)
    lowest = (jump[:n] < n) & (best[:n] == key)
    before[lowest] = np.flatnonzero(lowest)
    steps = (before != np.arange(n)).astype(np.int64)
    while (before[before] != before).any():
        steps, before = steps + steps[before], before[before]
    return before, steps


def _traced(width: int, here: Tile, parts: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_PIECES``: rings that close within a tile and stretches of those that leave it.

    ``node`` is the edge that a piece begins with and ``next`` the one after it, ``points`` are the corners at
    which its edges end.  A stretch is cut at its lowest edge, so that each ring's lowest begins a piece.
    """
    i, j, d, *to = _edges(here, parts)
    x, y, x2, y2 = (f + place + np.array([b[k] for b in _BEGIN])[side % 4] for side in (d, d + 1) for k, (f, place) in enumerate(((here.col, j), (here.row, i))))
    key = (y * (width + 1) + x) * 4 + d
    inside = (to[0] >= 0) & (to[0] < here.height) & (to[1] >= 0) & (to[1] < here.width)
    index = np.full(here.height * here.width * 4, -1)
    index[(i * here.width + j) * 4 + d] = np.arange(len(d))
    after = np.full(len(d), len(d))
    after[inside] = index[((to[0] * here.width + to[1]) * 4 + to[2])[inside]]
    head, steps = _heads(after, key)
    order = np.lexsort((steps, head))
    first = np.flatnonzero(np.concatenate([[True], head[order][1:] != head[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    if len(first):
        low = np.minimum.reduceat(key[order], first)
        first = np.union1d(first, np.flatnonzero(key[order] == np.repeat(low, np.diff(np.append(first, len(order))))))
    begin, end = order[first], order[np.append(first[1:], len(order)) - 1] if len(first) else first
    corner = (to[2] != d)[order]
    cross = (x * y2 - x2 * y)[order]
    counts, crosses = (np.add.reduceat(v, first) if len(first) else first for v in (corner.astype(np.int64), cross))
    flat = np.stack([x2[order][corner], y2[order][corner]], 1).astype(float).ravel()
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2), pa.int32()), pa.array(flat))
    points = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pairs)
    following = ((y2 * (width + 1) + x2) * 4 + to[2])[end]
    columns = [pa.array(v) for v in (parts[1:-1, 1:-1][i, j][begin], key[begin], following, following == key[begin], crosses)]
    return pa.RecordBatch.from_arrays([*columns, points], ["component", "node", "next", "closed", "cross", "points"])


def _places(pieces: DataFrame) -> DataFrame:
    """(node, ring, far) of pieces (node, next): the lowest piece of each one's ring and the steps on to it, by pointer jumping.

    Every round doubles how far each piece has looked ahead.
    """
    state = settled(pieces.select("node", F.col("next").alias("jump"), F.col("node").alias("best"), F.lit(0).cast("long").alias("far")))
    span, before = 1, None
    while True:
        # ``best`` is the lowest of the next ``span`` pieces, ``far`` how many steps on it lies.
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("best").alias("_best"), (F.col("far") + span).alias("_far"))
        closer = F.col("_best") < F.col("best")
        best, far = F.when(closer, F.col("_best")).otherwise(F.col("best")), F.when(closer, F.col("_far")).otherwise(F.col("far"))
        state = settled(state.join(ahead, "jump").select("node", F.col("_jump").alias("jump"), best.alias("best"), far.alias("far")))
        span *= 2
        total = state.agg(F.sum("far"), F.count_if(F.col("far") > 0)).first()
        # When a doubling of the span finds nothing lower anywhere, all have found the lowest of their ring.
        if total == before:
            break
        before = total
    return state.select("node", F.col("best").alias("ring"), "far")


def rings(cells: DataFrame, width: int, block: int = TILE) -> DataFrame:
    """(component, ring, area, points) of cells (r, c, component): closed rings of (x, y) pixel corners.

    ``area`` is in cells, positive for the outer ring of a component and negative for holes.
    Edges are followed within tiles of ``block`` pixels; only what leaves a tile is linked by joins.
    """

    def trace(here: Tile, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
        return _traced(width, here, np.nan_to_num(arrays["component"], nan=-1).astype(np.int64))

    height = (cells.agg(F.max("r")).first()[0] or 0) + 1
    pieces = settled(over_tiles(cells, ["component"], 1, _PIECES, trace, (height, width), "none", block))
    closed = pieces.filter("closed").select("component", F.col("node").alias("ring"), "cross", "points")
    linked = pieces.filter("not closed")
    linked = linked.join(_places(linked), "node")
    # The ring's first piece is nought steps from itself, the next ones most steps.
    piece = F.struct(F.when(F.col("far") == 0, F.lit(-(1 << 62))).otherwise(-F.col("far")).alias("k"), F.col("points").alias("p"))
    whole = linked.groupBy("component", "ring").agg(F.sum("cross").alias("cross"), F.array_sort(F.collect_list(piece)).alias("_pieces"))
    found = closed.unionByName(whole.select("component", "ring", "cross", F.flatten(F.transform("_pieces", lambda q: q["p"])).alias("points")))
    # The last edge ends where the first begins.
    return found.select("component", "ring", (F.col("cross") / 2.0).alias("area"), F.concat(F.slice("points", -1, 1), F.col("points")).alias("points"))


def polygonise(df: DataFrame, label: str, width: int, tile: int | None = None, block: int = TILE) -> DataFrame:
    """(component, label, pixels, holes, rings) of every patch of one label that touches by sides.

    ``rings`` are closed arrays of (x, y) pixel corners, the outer ring first, clockwise
    where rows run down, then holes by where they begin.  A null label makes no polygon.
    With ``tile`` patches are split at the edges of tiles of so many pixels, which bounds
    what one polygon holds.  A component is named by its first pixel, r * width + c.
    Tasks work on blocks of ``block`` pixels, on which the result doesn't depend.
    """
    named = df.filter(F.col(label).isNotNull()).select("r", "c", F.col(label).alias("_label"))
    cells = settled(connected(named, width, "_label", corners=False, cut=tile, tile=block))
    sizes = cells.groupBy("component").agg(F.first("_label").alias(label), F.count(F.lit(1)).alias("pixels"))
    made = rings(cells.select("r", "c", "component"), width, block)
    first = F.struct((F.col("area") < 0).alias("hole"), "ring", "points")
    shapes = made.groupBy("component").agg(F.array_sort(F.collect_list(first)).alias("_rings"))
    out = F.transform("_rings", lambda x: x["points"])
    return shapes.join(sizes, "component").select("component", label, "pixels", (F.size("_rings") - 1).alias("holes"), out.alias("rings"))


def in_map(rings: Column, left: float, top: float, pixel: float) -> Column:
    """Rings of pixel corners as rings of map coordinates."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(F.lit(left) + p[0] * pixel, F.lit(top) - p[1] * pixel)))
