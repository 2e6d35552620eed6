"""Tiled rasters as Parquet, one folder per tile, with a class style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import MASKS, ROCKS


def tile_key(size: int) -> Column:
    """``tx_ty`` with three digits each."""
    return F.format_string("%03d_%03d", F.floor(F.col("c") / size).cast("int"), F.floor(F.col("r") / size).cast("int"))


def write_tiles(df: DataFrame, folder: str, size: int = 1024) -> None:
    """Rows of a tile lie together, so that reading one tile prunes all others."""
    df.withColumn("tile_key", tile_key(size)).repartition("tile_key").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("tile_key").parquet(folder)


def read_tiles(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    tiles = spark.read.parquet(folder)
    return tiles.filter(F.col("tile_key").isin(keys)) if keys else tiles


def encoded_score(score: Column) -> Column:
    """A score of 0 to 100 in one byte: rounded half to even, plus one; 0 is no data."""
    return F.when(score.isNull(), 0).otherwise(F.bround(score).cast("int") + 1)


def decoded_score(code: Column) -> Column:
    return F.when(code > 0, code - 1).cast("double")


def style(colors: dict[int, str]) -> str:
    """A QGIS style with one entry per class."""
    entries = "".join(f'<paletteEntry value="{k}" label="{n}" color="{colors.get(k, "#000000")}" alpha="255"/>' for k, n in (ROCKS | MASKS).items())
    return f'<qgis><pipe><rasterrenderer type="paletted" band="1"><colorPalette>{entries}</colorPalette></rasterrenderer></pipe></qgis>'
