"""Deterministic raster views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel of a raster 100 columns wide: bands, elevation, scene code, true class."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    located = events.withColumn("r", F.expr(f"id div {WIDTH}")).withColumn("c", F.col("id") % WIDTH)
    classed = located.withColumn("k", (F.floor(F.col("r") / 8) * 3 + F.floor(F.col("c") / 8) * 5) % 7 + 1)
    band = lambda base, step, a, m: (base + step * F.col("k") + (F.col("id") * a) % m) / 1000.0
    codes = {"purchase": 4, "view": 5, "click": 6, "signup": 11, "error": 9}
    scl = F.lit(None)
    for name, code in codes.items():
        scl = F.when(F.col("event_type") == name, code).otherwise(scl)
    return classed.select(
        "id", "r", "c", "k",
        band(60, 25, 7, 41).alias("blue"), band(70, 28, 11, 43).alias("green"), band(80, 30, 13, 47).alias("red"),
        band(100, 33, 17, 53).alias("nir"), band(140, 36, 19, 59).alias("swir1"), band(120, 34, 23, 61).alias("swir2"),
        (F.lit(1000.0) + 12 * F.col("c") + 3 * F.col("r") + F.col("value") / 10).alias("dem"), scl.cast("int").alias("scl"),
    )
