"""Kernels over tiles with a halo: one shuffle by tile, then numpy on whole tiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import with_halo

#: Pixels along the side of a tile.
TILE = 256


@dataclass(frozen=True)
class Tile:
    """A tile's first row and column, its size without the halo, and how far that reaches."""

    row: int
    col: int
    height: int
    width: int
    reach: int

    def inner(self, a: np.ndarray) -> np.ndarray:
        """The tile's own cells of an array with the halo."""
        return a[self.reach : self.reach + self.height, self.reach : self.reach + self.width]


def raster_size(df: DataFrame) -> tuple[int, int]:
    """Rows and columns of a raster that begins at (0, 0)."""
    row = df.agg(F.max("r"), F.max("c")).first()
    return (row[0] + 1, row[1] + 1) if row[0] is not None else (0, 0)


def _folded(at: np.ndarray, size: int, edge: str) -> np.ndarray:
    """Places within the raster that stand for places beyond it: mirrored with or without the outer pixel, or -1."""
    if edge == "none":
        return np.where((at >= 0) & (at < size), at, -1)
    period = 2 * size if edge == "symmetric" else max(1, 2 * size - 2)
    at = np.mod(at, period)
    last = 2 * size - 1 if edge == "symmetric" else period
    return np.where(at < size, at, last - at)


def over_tiles(df: DataFrame, reads: list[str], reach: int, schema: str, function: Callable[[Tile, dict[str, np.ndarray]], pa.RecordBatch | pa.Table], size: tuple[int, int], edge: str = "symmetric", tile: int = TILE) -> DataFrame:
    """What ``function`` makes of every tile: the rows of one table for each.

    It gets the columns ``reads`` as arrays of the tile with ``reach`` more cells on each
    side, NaN where a pixel is missing or null; beyond the raster of ``size`` they are mirrored,
    the outer pixel repeated (``symmetric``) or not (``reflect``), or NaN (``none``).  Tiles
    smaller than the reach are mirrored within what their neighbours send, which is
    enough as long as the raster is larger than the reach.
    """
    height, width = size

    def whole(table: pa.Table) -> pa.Table:
        first = int(table.column("tr")[0].as_py()) * tile, int(table.column("tc")[0].as_py()) * tile
        here = Tile(*first, min(tile, height - first[0]), min(tile, width - first[1]), reach)
        r, c = (table.column(x).to_numpy() for x in ("r", "c"))
        # What the tile holds, by its place in a window that spans the halo.
        base = first[0] - reach, first[1] - reach
        span = here.height + 2 * reach, here.width + 2 * reach
        rows, cols = (_folded(np.arange(b, b + n), m, edge) - b for b, n, m in zip(base, span, size, strict=True))
        arrays = {}
        for name in reads:
            held = np.full((span[0] + 1, span[1] + 1), np.nan)
            held[r - base[0], c - base[1]] = table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            held[-1], held[:, -1] = np.nan, np.nan
            # Beyond a raster without mirrors, places point to the spare row and column.
            arrays[name] = held[np.ix_(np.where((rows >= 0) & (rows < span[0]), rows, -1), np.where((cols >= 0) & (cols < span[1]), cols, -1))]
        made = function(here, arrays)
        return made if isinstance(made, pa.Table) else pa.Table.from_batches([made])

    sent = with_halo(df.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *reads), tile, reach).drop("inner")
    inside = (F.col("tr") * tile < height) & (F.col("tc") * tile < width)
    return sent.filter(inside).groupBy("tr", "tc").applyInArrow(whole, schema)


@dataclass(frozen=True)
class Kernel:
    """What makes the columns ``makes`` from one column, which it sees ``reach`` cells around; beyond the raster NaN or mirrored."""

    makes: tuple[str, ...]
    reads: str
    reach: int
    function: Callable[[np.ndarray], tuple[np.ndarray, ...]]
    mirrored: bool = True


def mean(out: str, value: str, size: int) -> Kernel:
    """Mean of the known cells in a square of odd ``size``."""

    def make(a: np.ndarray) -> tuple[np.ndarray, ...]:
        known = ~np.isnan(a)
        total, n = (_boxed(x, size) for x in (np.where(known, a, 0.0), known.astype(float)))
        return (np.where(n > 0, total / np.maximum(n, 1), np.nan),)

    return Kernel((out,), value, size // 2, make)


def _boxed(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over squares; cells are added one by one, so that nothing is lost by subtraction."""
    h, w = a.shape[0] - size + 1, a.shape[1] - size + 1
    across = sum(a[:, k : k + w] for k in range(size))
    return sum(across[k : k + h] for k in range(size))


def extreme(out: str, value: str, size: int, how: str) -> Kernel:
    """Largest (``max``) or lowest (``min``) known cell in a square of odd ``size``."""
    pick = np.fmax if how == "max" else np.fmin

    def make(a: np.ndarray) -> tuple[np.ndarray, ...]:
        for axis in (1, 0):
            n = a.shape[axis] - size + 1
            parts = [np.take(a, range(k, k + n), axis) for k in range(size)]
            a = parts[0]
            for x in parts[1:]:
                a = pick(a, x)
        return (a,)

    return Kernel((out,), value, size // 2, make)


def slopes(dz_dx: str, dz_dy: str, value: str, pixel: float) -> Kernel:
    """Central differences, one-sided beside unknown cells and at the edges, 0 between two of these."""

    def make(a: np.ndarray) -> tuple[np.ndarray, ...]:
        own, out = a[1:-1, 1:-1], []
        for before, after in ((a[1:-1, :-2], a[1:-1, 2:]), (a[:-2, 1:-1], a[2:, 1:-1])):
            found = np.zeros(own.shape)
            for x in ((own - before) / pixel, (after - own) / pixel, (after - before) / (2 * pixel)):
                found = np.where(np.isnan(x), found, x)
            out.append(found)
        return tuple(out)

    return Kernel((dz_dx, dz_dy), value, 1, make, mirrored=False)


def steepness(out: str, value: str) -> Kernel:
    """Magnitude of the 3 x 3 Sobel gradient."""

    def make(a: np.ndarray) -> tuple[np.ndarray, ...]:
        smooth = [a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:], a[:-2] + 2 * a[1:-1] + a[2:]]
        return (np.hypot(smooth[1][:, 2:] - smooth[1][:, :-2], smooth[0][2:] - smooth[0][:-2]),)

    return Kernel((out,), value, 1, make)


def with_kernels(df: DataFrame, kernels: list[Kernel], size: tuple[int, int] | None = None, tile: int = TILE) -> DataFrame:
    """``df`` and the columns that kernels make, all after one shuffle by tile with the widest kernel's halo.

    Rows outside the raster of ``size`` (rows, columns; found if not given) don't come back, nor do
    pixels of null place; every other column goes along untouched.
    """
    height, width = size or raster_size(df)
    reach, reads = max(k.reach for k in kernels), sorted({k.reads for k in kernels})
    made = [m for k in kernels for m in k.makes]
    kept = [c for c in df.columns if c not in made]

    def whole(table: pa.Table) -> pa.Table:
        first = int(table.column("tr")[0].as_py()) * tile, int(table.column("tc")[0].as_py()) * tile
        here = Tile(*first, min(tile, height - first[0]), min(tile, width - first[1]), reach)
        span = here.height + 2 * reach, here.width + 2 * reach
        r, c = (table.column(x).to_numpy() - b + reach for x, b in zip(("r", "c"), first, strict=True))
        places = [_folded(np.arange(b - reach, b - reach + n), m, "symmetric") - b + reach for b, n, m in zip(first, span, (height, width), strict=True)]
        plain, mirrored = {}, {}
        for name in reads:
            held = np.full(span, np.nan)
            held[r, c] = table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            plain[name] = held
            mirrored[name] = held[np.ix_(*(np.clip(p, 0, n - 1) for p, n in zip(places, span, strict=True)))]
        own = table.column("inner").combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        out = table.filter(pa.array(own)).select(kept)
        r, c = r[own] - reach, c[own] - reach
        for k in kernels:
            cut = reach - k.reach
            a = (mirrored if k.mirrored else plain)[k.reads]
            for name, values in zip(k.makes, k.function(a[cut : a.shape[0] - cut, cut : a.shape[1] - cut]), strict=True):
                out = out.append_column(name, pa.array(values[r, c], from_pandas=True))
        return out

    sent = with_halo(df.select(*kept), tile, reach).filter((F.col("tr") * tile < height) & (F.col("tc") * tile < width))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept] + [f"`{m}` double" for m in made]
    return sent.groupBy("tr", "tc").applyInArrow(whole, ", ".join(fields))


def cells(here: Tile, columns: dict[str, np.ndarray], present: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (r, c, columns) of the tile's own cells; NaN is null."""
    r, c = (x.ravel() for x in np.mgrid[here.row : here.row + here.height, here.col : here.col + here.width])
    keep = np.ones(len(r), bool) if present is None else present.ravel()
    arrays = [pa.array(x[keep]) for x in (r, c)] + [pa.array(v.ravel()[keep], from_pandas=True) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["r", "c", *columns])


def shifted_sum(a: np.ndarray, weights: dict[tuple[int, int], float], reach: int) -> np.ndarray:
    """Sum of the cells at (dr, dc) times their weights, for every cell at least ``reach`` from the border."""
    h, w = a.shape[0] - 2 * reach, a.shape[1] - 2 * reach
    out = np.zeros((h, w))
    for (dr, dc), weight in weights.items():
        out += weight * a[reach + dr : reach + dr + h, reach + dc : reach + dc + w]
    return out


def patch_sums(df: DataFrame, value: str, weights: dict[tuple[int, int], float], out: str, edge: str = "reflect") -> DataFrame:
    """(r, c, out): the weighted sum of the patch around every pixel, without a row for each of its cells."""
    reach = max(max(abs(a), abs(b)) for a, b in weights)

    def make(here: Tile, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
        return cells(here, {out: shifted_sum(arrays[value], weights, reach)}, ~np.isnan(here.inner(arrays[value])))

    return over_tiles(df, [value], reach, f"r long, c long, `{out}` double", make, raster_size(df), edge)
