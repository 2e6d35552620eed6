"""A network of convolutions over 9 x 9 cells, trained and applied on tiles with a halo.

A first layer mixes the features of a cell, four layers of 3 x 3 cells follow, two
more mix what they found.  Every cell of a tile is computed at once, so that
no cell's patch is made by itself.  Each round, tasks go on from the same weights
through their own tiles; then weights are averaged by how many labels a task has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .halos import Tile, cells, over_tiles, raster_size
from .targets import settled

REACH = 4
#: Share of a label that goes to all classes; decay of weights.
SMOOTHING, DECAY = 0.05, 1e-4
#: Tasks that add up what the others have learned.
MERGE_TASKS = 16
_PACKED = "row long, col long, height int, width int, features binary, labels binary, n long"

Weights = list[np.ndarray]


def initial(n_features: int, n_classes: int, width: int, seed: int = 0) -> Weights:
    """Weights (rows, columns, from, to) and offsets of all layers."""
    rng = np.random.default_rng(seed)
    shapes = [(1, n_features, width), (3, width, width), (3, width, width), (3, width, 2 * width), (3, 2 * width, 2 * width), (1, 2 * width, 2 * width), (1, 2 * width, n_classes)]
    out: Weights = []
    for k, a, b in shapes:
        out += [rng.normal(0, np.sqrt(2 / (k * k * a)), (k, k, a, b)), np.zeros(b)]
    return out


def _patches(x: np.ndarray, k: int) -> np.ndarray:
    """The k x k cells that each cell of the next layer sees, a row each: one large product does what k * k small ones would."""
    if k == 1:
        return np.ascontiguousarray(x).reshape(-1, x.shape[2])
    seen = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(0, 1))
    return seen.transpose(0, 1, 3, 4, 2).reshape(-1, k * k * x.shape[2])


def _convolved(x: np.ndarray, w: np.ndarray, offset: np.ndarray) -> np.ndarray:
    k = w.shape[0]
    out = _patches(x, k) @ w.reshape(-1, w.shape[3])
    out += offset
    return out.reshape(x.shape[0] - k + 1, x.shape[1] - k + 1, -1)


def _back(x: np.ndarray, w: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a layer's weights and of what went into it."""
    k, n = w.shape[0], grad.shape[2]
    dw = (_patches(x, k).T @ grad.reshape(-1, n)).reshape(w.shape)
    # A cell got into the next layer's cells around it, by the weights turned around.
    wide = np.zeros((grad.shape[0] + 2 * k - 2, grad.shape[1] + 2 * k - 2, n), grad.dtype)
    wide[k - 1 : k - 1 + grad.shape[0], k - 1 : k - 1 + grad.shape[1]] = grad
    dx = _patches(wide, k) @ w[::-1, ::-1].transpose(0, 1, 3, 2).reshape(-1, w.shape[2])
    return dw, dx.reshape(x.shape)


def forward(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """What goes into each layer, and at last the scores of classes, 8 cells smaller than ``x``."""
    held = [x]
    for k in range(0, len(weights), 2):
        x = _convolved(x, weights[k], weights[k + 1])
        if k < len(weights) - 2:
            x = np.maximum(x, 0)
        held.append(x)
    return held


def chances(weights: Weights, x: np.ndarray) -> np.ndarray:
    scores = forward(weights, x)[-1]
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def loss_and_gradient(weights: Weights, x: np.ndarray, y: np.ndarray, class_weight: np.ndarray) -> tuple[float, Weights]:
    """Mean weighted cross entropy of smoothed labels, and its gradient; cells with ``y`` below 0 have no label.

    All in the precision of ``x`` and the weights.
    """
    held = forward(weights, x)
    class_weight = class_weight.astype(x.dtype)
    scores, n = held[-1], len(class_weight)
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    p = e / e.sum(axis=2, keepdims=True)
    there = y >= 0
    # The labels' shares, each class by its own weight.
    target = np.where(there[..., None], (1 - SMOOTHING) * (np.arange(n) == y[..., None]) + SMOOTHING / n, 0.0).astype(x.dtype) * class_weight
    total = max(1e-12, class_weight[y[there]].sum())
    loss = -(target * np.log(np.maximum(p, np.finfo(p.dtype).tiny))).sum() / total
    grad = (p * target.sum(axis=2, keepdims=True) - target) / total
    out: Weights = [np.empty(0)] * len(weights)
    for k in range(len(weights) - 2, -1, -2):
        out[k + 1] = grad.sum(axis=(0, 1))
        out[k], grad = _back(held[k // 2], weights[k], grad)
        if k:
            grad = grad * (held[k // 2] > 0)
    return float(loss), out


def packed(weights: Weights) -> bytes:
    return np.concatenate([w.ravel() for w in weights]).astype("<f8").tobytes()


def unpacked(data: bytes, like: Weights) -> Weights:
    flat, out, at = np.frombuffer(data, "<f8"), [], 0
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape).copy())
        at += w.size
    return out


@dataclass
class ConvNet:
    """Classes in the order of scores, the columns read, their means and deviations, and the weights."""

    classes: list[int]
    features: list[str]
    mean: list[float]
    deviation: list[float]
    weights: Weights

    def predict(self, df: DataFrame, tile: int = 128) -> DataFrame:
        """(r, c, class, confidence, chances) of every pixel that has all features; one row a pixel, computed tile by tile."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} of the network are missing")
        sent = df.sparkSession.sparkContext.broadcast(self.weights)  # some ten thousand numbers
        classes, names = np.array(self.classes, np.int32), [*self.features]
        mean, deviation = np.array(self.mean), np.array(self.deviation)

        def make(here: Tile, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
            x = (np.stack([arrays[f] for f in names], axis=2) - mean) / deviation
            own = ~np.isnan(here.inner(x)).any(axis=2)
            p = chances(sent.value, np.nan_to_num(x))
            rows = cells(here, {"class": classes[p.argmax(axis=2)], "confidence": p.max(axis=2)}, own)
            return rows.append_column("chances", pa.FixedSizeListArray.from_arrays(pa.array(p[own].ravel()), len(classes)).cast(pa.list_(pa.float64())))

        return over_tiles(df, names, REACH, "r long, c long, class int, confidence double, chances array<double>", make, raster_size(df), "reflect", tile)


def _turned(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A tile turned and mirrored at random: rocks have no preferred direction."""
    k, flip = int(rng.integers(4)), bool(rng.integers(2))
    x, y = np.rot90(x, k), np.rot90(y, k)
    return (x[::-1], y[::-1]) if flip else (x, y)


def fit(train: DataFrame, features: list[str], label: str, width: int = 16, rounds: int = 20, rate: float = 4e-3, tile: int = 32, seed: int = 0) -> ConvNet:
    """A network from pixels (r, c, features, label); a null label is one to look at but not to learn from.

    A step is one tile.  Steps are Adam's; its moments stay within a task and a round.
    Classes count the same, whatever their number of labels.
    """
    stats = train.agg(*[x for f in features for x in (F.avg(f), F.stddev_pop(f))]).first()
    mean = [float(x or 0.0) for x in stats[0::2]]
    deviation = [float(x or 0.0) + 1e-6 for x in stats[1::2]]
    counts = {int(r[0]): r[1] for r in train.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row a class
    classes = sorted(counts)
    if not classes:
        raise ValueError("no pixel has a label")
    total = sum(counts.values())
    class_weight = np.array([total / (len(classes) * counts[k]) for k in classes])

    def pack(here: Tile, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
        x = (np.stack([arrays[f] for f in features], axis=2) - mean) / deviation
        own = here.inner(arrays["_y"])
        y = np.full(own.shape, -1, np.int16)
        for i, k in enumerate(classes):
            y[own == k] = i
        columns = [pa.array([v]) for v in (here.row, here.col)] + [pa.array([v], pa.int32()) for v in own.shape]
        columns += [pa.array([np.nan_to_num(x).astype("<f4").tobytes()]), pa.array([y.tobytes()]), pa.array([int((y >= 0).sum())])]
        return pa.RecordBatch.from_arrays(columns, ["row", "col", "height", "width", "features", "labels", "n"])

    named = train.withColumn("_y", F.col(label).cast("double"))
    tiles = settled(over_tiles(named, [*features, "_y"], REACH, _PACKED, pack, raster_size(train), "reflect", tile).filter("n > 0"))
    weights = initial(len(features), len(classes), width, seed)
    for number in range(rounds):
        # Rates rise over the first third and fall to nothing.
        at = (number + 0.5) / rounds
        weights = _round(tiles, weights, class_weight, rate * min(1.0, 3 * at) * (1.0 if at < 1 / 3 else 1.5 * (1 - at)), number, seed, len(features))
    return ConvNet(classes, features, mean, deviation, weights)


def _round(tiles: DataFrame, weights: Weights, class_weight: np.ndarray, rate: float, number: int, seed: int, n_features: int) -> Weights:
    sent = tiles.sparkSession.sparkContext.broadcast(packed(weights))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Single precision, as tiles have it; what tasks send is summed in double precision.
        own, seen, step = [w.astype(np.float32) for w in unpacked(sent.value, weights)], 0, 0
        first, second = [np.zeros_like(w) for w in own], [np.zeros_like(w) for w in own]
        for batch in batches:
            for row in batch.to_pylist():
                shape = row["height"], row["width"]
                x = np.frombuffer(row["features"], "<f4").reshape(shape[0] + 2 * REACH, shape[1] + 2 * REACH, n_features)
                x, y = _turned(x, np.frombuffer(row["labels"], np.int16).reshape(shape), np.random.default_rng([seed, number, row["row"], row["col"]]))
                _, grad = loss_and_gradient(own, x, y, class_weight)
                step, seen = step + 1, seen + row["n"]
                for w, g, m, v in zip(own, grad, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([packed([w.astype(np.float64) * seen for w in own])]), pa.array([seen])], ["w", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(row["w"], "<f8")
                total, n = part if total is None else total + part, n + row["n"]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n])], ["w", "n"])

    schema = "w binary, n long"
    merged = tiles.mapInArrow(learn, schema).repartition(MERGE_TASKS).mapInArrow(add, schema).collect()  # a set of weights each
    n = sum(r["n"] for r in merged)
    return unpacked((sum(np.frombuffer(r["w"], "<f8") for r in merged) / n).tobytes(), weights)
