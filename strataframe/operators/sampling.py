"""Spatial splits and stratified samples, repeatable by hash."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portable_hash(*values: Column) -> Column:
    """A number below 2 ** 31 from non-negative integers, the same in any engine."""
    total = F.lit(0).cast("long")
    for v in values:
        total = ((total * 31 + v.cast("long")) % 2147483648 * 1103515245 + 12345) % 2147483648
    return total


def block_split(df: DataFrame, block: int = 32, shares: tuple[float, float] = (0.6, 0.15)) -> DataFrame:
    """Adds ``split``: 0 train, 1 validation, 2 test; whole blocks go to one of them."""
    placed = df.withColumn("by", F.floor(F.col("r") / block)).withColumn("bx", F.floor(F.col("c") / block))
    hashed = placed.select("by", "bx").distinct().withColumn("_h", portable_hash(F.col("by"), F.col("bx")))
    # Ranked within slices of the hashes; the slices before one are summed over a few hundred rows.
    sliced = hashed.withColumn("_slice", F.shiftright("_h", 23))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy("_h", "by", "bx"))
    ranked = sliced.withColumn("_place", place).join(F.broadcast(offsets), "_slice").withColumn("_rank", F.col("_before") + F.col("_place"))
    train, val = F.bround(F.col("_n") * shares[0]), F.bround(F.col("_n") * shares[1])
    split = F.when(F.col("_rank") <= train, 0).when(F.col("_rank") <= train + val, 1).otherwise(2)
    return placed.join(ranked.select("by", "bx", split.alias("split")), ["by", "bx"]).drop("by", "bx")


def stratified(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each class, those of lowest hash."""
    order = Window.partitionBy(label).orderBy(portable_hash(F.col(key)), key)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")


# Least numbers of samples of the checking and testing parts of a class.
LEAST_CHECK, LEAST_TEST = 500, 1000


def caps(per_class: int, share: float = 1.0) -> dict[str, int]:
    """Samples a class may give to each part; ``share`` is a tile's part of them."""
    base = {"train": per_class, "val": max(LEAST_CHECK, per_class // 4), "test": max(LEAST_TEST, per_class // 2)}
    return {part: max(1, math.ceil(n * share)) for part, n in base.items()}


def pooled(samples: DataFrame, source: str, part: str, label: str, order: str, per_class: int, sources: int) -> DataFrame:
    """Samples of several tiles or areas: each gives its share, then each class is held to its cap again."""
    limit = lambda share: functools.reduce(lambda out, x: F.when(F.col(part) == x[0], x[1]).otherwise(out), caps(per_class, share).items(), F.lit(0))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(portable_hash(F.col(order)), order))
    each = samples.withColumn("_n", place(source, part, label)).filter(F.col("_n") <= limit(min(1.0, 3 / sources)))
    return each.withColumn("_n", place(part, label)).filter(F.col("_n") <= limit(1.0)).drop("_n")
