"""All overview levels of a raster from one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The factors of overviews, and the least size of the longer side of one.
FACTORS = (2, 4, 8, 16, 32, 64)
LEAST = 256


def factors(width: int, height: int, least: int = LEAST) -> list[int]:
    """Factors that leave the longer side at least ``least`` pixels."""
    return [f for f in FACTORS if max(width, height) / f >= least]


def pyramid(df: DataFrame, levels: int, values: list[str], labels: list[str]) -> DataFrame:
    """(level, r, c, values, labels) of levels 1 to ``levels``, each of half the size of the one before.

    Level k is ``overview(df, 2**k)``: means of all values that aren't null, the upper left pixel of
    labels.  Rows are dealt once, by the block of the coarsest level, so that the blocks of every finer
    level lie within one task already: each level is made from the sums of the one below it without
    another shuffle.  A task holds no block as a whole; sums are all that is kept.  An empty raster
    gives no rows; other columns are dropped, names such as ``level`` may be among them.
    """
    if levels < 1:
        raise ValueError("a pyramid has one level at least")
    block = [F.floor(F.col(axis) / 2**levels).alias(f"_{axis}") for axis in ("r", "c")]
    first = F.struct("r", "c")
    sums = [F.struct(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias("s"), F.col(v).isNotNull().cast("long").alias("n")).alias(f"_v{i}") for i, v in enumerate(values)]
    at = [F.struct(first.alias("at"), F.col(x).alias("x")).alias(f"_x{i}") for i, x in enumerate(labels)]
    below = df.select("r", "c", *block, *sums, *at).repartition("_r", "_c")
    made = []
    for level in range(1, levels + 1):
        half = below.groupBy("_r", "_c", F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c"))
        below = half.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.struct(F.sum(f"_v{i}.s").alias("s"), F.sum(f"_v{i}.n").alias("n")).alias(f"_v{i}") for i in range(len(values))],
            *[F.min_by(f"_x{i}", f"_x{i}.at").alias(f"_x{i}") for i in range(len(labels))],
        ).drop("_n")
        means = [F.when(F.col(f"_v{i}.n") > 0, F.col(f"_v{i}.s") / F.col(f"_v{i}.n")).alias(v) for i, v in enumerate(values)]
        made.append(below.select(F.lit(level).alias("level"), "r", "c", *means, *[F.col(f"_x{i}.x").alias(x) for i, x in enumerate(labels)]))
    return reduce(DataFrame.unionByName, made)
