"""Support vector machines with a radial kernel, one for each two classes.

Each pair's dual problem is solved in a task of its own over a bounded sample of
candidates, so that no task holds more than ``MOST_ROWS`` rows, and kernel rows are
made as they are needed.  Applying the machine reads every pixel once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import portable_hash
from .targets import settled

#: Candidates at most, over all classes; cost; how near to the optimum.
MOST_ROWS, COST, TOLERANCE = 6000, 10.0, 1e-3
#: Bytes of kernel rows that are kept, steps after which a solution is taken as it is, pixels at once.
CACHE_BYTES, MOST_STEPS, AT_ONCE = 64 << 20, 200_000, 1024


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0))


def solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, gamma: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(weights, offset) of the dual problem for ``y`` of 1 and -1: weights within 0 and ``cost``, balanced over both sides.

    Each step takes the row that is most in need of more weight and the one that, with
    it, gains most, and moves weight between them, until no pair gains ``tolerance``.
    """
    n = len(y)
    weight, slack = np.zeros(n), -np.ones(n)  # slack: gradient of the dual
    held: dict[int, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        if i not in held:
            if len(held) * n * 8 > CACHE_BYTES:
                held.pop(next(iter(held)))
            held[i] = kernel(x[i : i + 1], x, gamma)[0]
        return held[i]

    high = low = 0.0
    for _ in range(MOST_STEPS):
        need = -y * slack
        up = np.where(y > 0, weight < cost, weight > 0)
        down = np.where(y > 0, weight > 0, weight < cost)
        if not up.any() or not down.any():
            break
        i = int(np.argmax(np.where(up, need, -np.inf)))
        high, low = need[i], np.where(down, need, np.inf).min()
        if high - low < tolerance:
            break
        near = row(i)
        gap = high - need
        gain = np.where(down & (gap > 0), gap * gap / np.maximum(2 - 2 * near, 1e-12), -1.0)
        j = int(np.argmax(gain))
        room = min(cost[i] - weight[i] if y[i] > 0 else weight[i], weight[j] if y[j] > 0 else cost[j] - weight[j])
        step = min(gap[j] / max(2 - 2 * near[j], 1e-12), room)
        weight[i] = min(max(weight[i] + y[i] * step, 0.0), cost[i])
        weight[j] = min(max(weight[j] - y[j] * step, 0.0), cost[j])
        slack += y * step * (near - row(j))
    free = (weight > 0) & (weight < cost)
    return weight, float((-y * slack)[free].mean()) if free.any() else float((high + low) / 2)


def candidates(train: DataFrame, label: str, key: str, most: int = MOST_ROWS) -> DataFrame:
    """At most ``most`` rows, each class in its share and with one row at least, those of lowest hash."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    # Only rows whose hash lies below twice a class's share are ordered, or all of a small class.
    shares = counts.crossJoin(F.broadcast(total)).withColumn("_take", F.greatest(F.lit(1), F.floor(F.col("_n") * F.least(F.lit(1.0), F.lit(float(most)) / F.col("_all")))))
    hashed = train.withColumn("_h", portable_hash(F.col(key))).join(F.broadcast(shares.select(label, "_n", "_take")), label)  # a row a class
    near = hashed.filter((F.col("_h") < 2.0**31 * 2 * (F.col("_take") + 50) / F.col("_n")))
    return near.withColumn("_place", place).filter(F.col("_place") <= F.col("_take")).drop("_h", "_n", "_take", "_place")


@dataclass
class KernelMachine:
    """Classes in order, columns read, their means and deviations, vectors, and for each two classes weights of these and an offset."""

    classes: list[int]
    features: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    gamma: float
    vectors: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def decisions(self, x: np.ndarray) -> np.ndarray:
        """For scaled rows: of each class the votes of its pairs, and as a tie-break how clear they were."""
        n = len(self.classes)
        clear = kernel(x, self.vectors, self.gamma) @ self.weights.T + self.offsets
        votes, sums = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (a, b) in enumerate(combinations(range(n), 2)):
            votes[:, a] += clear[:, k] > 0
            votes[:, b] += clear[:, k] <= 0
            sums[:, a] += clear[:, k]
            sums[:, b] -= clear[:, k]
        return votes + sums / (3 * (np.abs(sums) + 1)) if n > 1 else votes + 1

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Pseudo-probabilities: the softmax of twice the margin to the largest decision."""
        d = self.decisions(x)
        e = np.exp(2 * (d - d.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``class``, ``confidence`` and ``chances``; null where a feature is."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} of the machine are missing")
        sent = df.sparkSession.sparkContext.broadcast(self)  # MOST_ROWS vectors at most

        @F.pandas_udf("struct<class: int, confidence: double, chances: array<double>>")
        def judge(*columns: pd.Series) -> pd.DataFrame:
            machine = sent.value
            x = (np.stack([c.to_numpy(float) for c in columns], axis=1) - machine.mean) / machine.deviation
            known = ~np.isnan(x).any(axis=1)
            p = np.zeros((len(x), len(machine.classes)))
            for k in range(0, len(x), AT_ONCE):
                p[k : k + AT_ONCE] = machine.chances(np.nan_to_num(x[k : k + AT_ONCE]))
            names = np.array(machine.classes)[p.argmax(axis=1)]
            return pd.DataFrame({"class": pd.Series(names, dtype="Int32").where(known), "confidence": pd.Series(p.max(axis=1)).where(known), "chances": pd.Series([q if ok else None for q, ok in zip(p, known, strict=True)], dtype=object)})

        found = df.withColumn("_found", judge(*[F.col(f).cast("double") for f in self.features]))
        return found.select(*[c for c in df.columns if c not in ("class", "confidence", "chances")], "_found.*")


def fit(train: DataFrame, features: list[str], label: str, key: str, cost: float = COST, most: int = MOST_ROWS) -> KernelMachine:
    """A machine from rows with whole features; classes count the same.  The kernel's width follows from the scaled features' variance."""
    known = train.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    stats = known.agg(*[x for f in features for x in (F.avg(f), F.stddev_pop(f))]).first()
    mean, deviation = (np.array([float(x or 0.0) for x in stats[k::2]]) + e for k, e in ((0, 0.0), (1, 1e-6)))
    row = F.array(*[(F.col(f) - float(m)) / float(d) for f, m, d in zip(features, mean, deviation, strict=True)])
    sample = settled(candidates(known, "label", "key", most).select("key", "label", row.alias("x")))
    picked = sample.orderBy("label", "key").collect()  # ``most`` rows at most
    if not picked:
        raise ValueError("no row has a label and all features")
    x, y = np.array([r.x for r in picked]), np.array([r.label for r in picked])
    classes, variance = sorted(set(y.tolist())), float(x.var())
    gamma = 1.0 / (len(features) * variance) if variance > 0 else 1.0
    share = {k: len(y) / (len(classes) * int((y == k).sum())) for k in classes}
    pairs = list(combinations(range(len(classes)), 2))
    weights, offsets = np.zeros((len(pairs), len(x))), np.zeros(len(pairs))
    if pairs:
        spark = train.sparkSession
        asked = F.broadcast(spark.createDataFrame([(k, classes[c], 1.0 if c == a else -1.0) for k, (a, b) in enumerate(pairs) for c in (a, b)], "pair int, label int, side double"))
        each = sample.join(asked, "label")

        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by([("label", "ascending"), ("key", "ascending")])
            rows = np.array(table.column("x").to_pylist())
            limits = np.array([cost * share[k] for k in table.column("label").to_pylist()])
            side = table.column("side").to_numpy()
            weight, offset = solve(rows, side, limits, gamma)
            return pa.table({"pair": table.column("pair").slice(0, 1), "weights": pa.array([(weight * side).tolist()]), "offset": pa.array([offset])})

        for row_ in each.groupBy("pair").applyInArrow(one, "pair int, weights array<double>, offset double").collect():  # a row a pair
            a, b = pairs[row_.pair]
            weights[row_.pair, (y == classes[a]) | (y == classes[b])] = row_.weights
            offsets[row_.pair] = row_.offset
    used = (weights != 0).any(axis=0)
    return KernelMachine(classes, features, mean, deviation, gamma, x[used], weights[:, used], offsets)
