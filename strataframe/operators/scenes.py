"""Scenes and observations: deduplication, ordering, compositing, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import SCL_CLEAR, SCL_SNOW, SCL_WATER


def best_per_day(scenes: DataFrame) -> DataFrame:
    """One scene per granule and day, the least cloudy; ties by id."""
    rank = F.row_number().over(Window.partitionBy("granule", "day").orderBy("cloud", "item"))
    return scenes.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def search_order() -> list[Column]:
    """Five-percent steps of cloud first, newest first within a step; ties by id."""
    return [F.floor(F.col("cloud") / 5), F.col("day").desc(), F.col("item")]


def round_robin(scenes: DataFrame) -> DataFrame:
    """Adds ``turn``: the place of a scene within its granule; granules take turns."""
    return scenes.withColumn("turn", F.row_number().over(Window.partitionBy("granule").orderBy(*search_order())))


def composite(observations: DataFrame, cell: list[str], bands: list[str]) -> DataFrame:
    """Median of clear observations per cell and band, of snow only where none is clear.

    Gives reflectance times 10000, cut to a whole number, and a scene code: 4 clear,
    6 where most observations are water, 11 snow, 0 none.
    """
    clear = F.col("scl").isin(*SCL_CLEAR, SCL_WATER)
    snow = F.col("scl") == SCL_SNOW
    medians = [F.median(F.when(clear, F.col(b))).alias(f"_c_{b}") for b in bands] + [F.median(F.when(snow, F.col(b))).alias(f"_s_{b}") for b in bands]
    counts = [F.count_if(clear).alias("n_clear"), F.count_if(snow).alias("n_snow"), F.count_if(F.col("scl") == SCL_WATER).alias("n_water")]
    each = observations.groupBy(*cell).agg(*medians, *counts)
    has_clear, has_snow = F.col("n_clear") > 0, F.col("n_snow") > 0
    water = F.col("n_water") * 2 > F.col("n_clear") + F.col("n_snow")
    code = F.when(has_clear, F.when(water, SCL_WATER).otherwise(4)).when(has_snow, SCL_SNOW).otherwise(0)

    def out(b: str) -> Column:
        value = F.when(has_clear, F.col(f"_c_{b}")).otherwise(F.col(f"_s_{b}"))
        return F.when(value.isNull(), 0).otherwise(F.least(F.greatest(value * 10000, F.lit(1.0)), F.lit(65535.0)).cast("int")).alias(b)

    return each.select(*cell, *[out(b) for b in bands], code.alias("code"), "n_clear", "n_snow", "n_water")


def first_valid(readings: DataFrame, cell: list[str], order: str, value: str) -> DataFrame:
    """The first reading of each cell, in order, that isn't missing."""
    there = F.col(value).isNotNull() & ~F.isnan(value)
    return readings.filter(there).groupBy(*cell).agg(F.min_by(value, order).alias(value))


def overview(df: DataFrame, factor: int, values: list[str], labels: list[str]) -> DataFrame:
    """A raster of a fraction of the size: means of values, the upper left pixel of labels."""
    place = F.struct("r", "c")
    return df.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(
        *[F.avg(v).alias(v) for v in values], *[F.min_by(x, place).alias(x) for x in labels]
    )


def chosen(reads: DataFrame, granule: str, item: str, cloud: str, cells: str, total: int, quota: int, share: float, least: int = 2) -> DataFrame:
    """Scenes in turns over granules, the clearest first, until ``share`` of ``total`` cells is covered.

    Adds ``turn`` and ``covered``.  A granule gives ``quota`` scenes at most, so that the list
    in which turns are counted has ``quota`` rows a granule, however many scenes there are.
    """
    own = Window.partitionBy(granule).orderBy(cloud, item)
    few = reads.withColumn("_place", F.row_number().over(own)).filter(F.col("_place") <= quota)
    turns = few.withColumn("turn", F.row_number().over(Window.orderBy("_place", granule)))
    first = turns.select("turn", F.explode(cells).alias("_cell")).groupBy("_cell").agg(F.min("turn").alias("turn"))
    gained = first.groupBy("turn").agg(F.count(F.lit(1)).alias("_new"))
    upto = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    summed = turns.join(gained, "turn", "left").withColumn("covered", F.sum(F.coalesce("_new", F.lit(0))).over(upto) / total)
    enough = (F.col("covered") >= share) & (F.col("turn") >= least)
    done = summed.withColumn("_done", F.sum(enough.cast("int")).over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)))
    return done.filter(F.coalesce("_done", F.lit(0)) == 0).drop("_place", "_new", "_done")


def stacked(assets: DataFrame, cell: list[str], asset: str, dn: str, code: str, bands: dict[int, str], scene_code: int, offset: int = 0, scale: int = 10000) -> DataFrame:
    """One row per cell from single-band assets of a scene: mean reflectance of each band, and its scene code.

    Digital numbers are whole, so that sums are exact and one division makes the
    mean; after the offset none is below 0.  A band without rows is null.
    """
    value = F.greatest(F.col(dn).cast("long") + offset, F.lit(0))
    mean = lambda i: F.sum(F.when(F.col(asset) == i, value)).cast("double") / (F.count_if(F.col(asset) == i) * F.lit(float(scale)))
    guarded = [F.when(F.count_if(F.col(asset) == i) > 0, mean(i)).alias(b) for i, b in bands.items()]
    return assets.groupBy(*cell).agg(*guarded, F.max(F.when(F.col(asset) == scene_code, F.col(code))).cast("int").alias("scl"))
