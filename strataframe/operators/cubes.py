"""Hyperspectral cubes from files to mineral maps and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hyperspectral
from ..sources import cubes
from . import datasets

#: Depth above which a mineral is called strong.
STRONG = 0.3


def read(spark: SparkSession, path: str, bands: list[int]) -> DataFrame:
    cubes.register(spark)
    return spark.read.format("cube").option("bands", ",".join(map(str, bands))).load(path)


def scale_of(spark: SparkSession, path: str, band: int) -> float:
    """1e-4 where the median of a band's positive values is above 2, that is of digital numbers; else 1.

    The scan reads one band, and counts decide.
    """
    low = read(spark, path, [band]).select(F.get("spectrum", 0).alias("v")).filter("v > 0").agg(datasets.at_most("v", 0.5, 2.0)).first()[0]
    return 1e-4 if low is False else 1.0


def mineral_map(spark: SparkSession, path: str, scale: float | None = None) -> DataFrame:
    """(r, c, code, depth of each measurable mineral) of the cube or the folder of cubes at ``path``.

    ``code`` is 0 without data, 1 where no mineral of the short-wave infrared is deep enough, else one
    more than the mineral's place in the table.  A pixel has data if no needed band is missing and
    their sum is above 0; its depths are 0 otherwise.  Only needed bands are read.
    """
    waves = list(cubes.read_header(path).wavelengths)
    if not waves:
        raise ValueError(f"the header at {path} names no wavelengths")
    need = hyperspectral.needed_bands(waves)
    if not need:
        raise ValueError("no band lies at an absorption of the table")
    factor = scale_of(spark, path, need[len(need) // 2]) if scale is None else scale
    raw = read(spark, path, need)
    total = F.aggregate("spectrum", F.lit(0.0), lambda a, v: a + v)  # null if a band is missing
    there = raw.withColumn("_there", F.coalesce(total > 0, F.lit(False)))
    scaled = there.withColumn("_s", F.transform("spectrum", lambda v: v * factor))
    depths = hyperspectral.with_depths(scaled, "_s", waves, need)
    names = [m for m in hyperspectral.MAIN if m in depths.columns]
    kept = depths.withColumns({m: F.when(F.col("_there"), F.col(m)).otherwise(0.0) for m in names})
    code = F.when(F.col("_there"), hyperspectral.deepest(names) + 1).otherwise(0).cast("int")
    return kept.select("r", "c", code.alias("code"), *names)


def mineral_areas(mapped: DataFrame, pixel_km2: float = 0.0009) -> DataFrame:
    """(mineral, pixels, strong, km2) of a mineral map, from depths: a pixel may hold several minerals."""
    names = [m for m in hyperspectral.MAIN if m in mapped.columns]
    counts = [F.struct(F.lit(m).alias("mineral"), F.count_if(F.col(m) >= hyperspectral.MIN_DEPTH).alias("pixels"), F.count_if(F.col(m) >= STRONG).alias("strong")) for m in names]
    # one row of counts, then a row for each mineral: nothing is spread out before it is counted
    return mapped.agg(F.array(*counts).alias("_m")).select(F.inline("_m")).withColumn("km2", F.col("pixels") * pixel_km2)
