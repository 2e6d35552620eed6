"""Histograms, area and accuracy statistics, robust scales, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classes import MASKS, ROCKS
from . import selection


def class_dimension(spark: SparkSession) -> DataFrame:
    rows = [(k, n, True) for k, n in ROCKS.items()] + [(k, n, False) for k, n in MASKS.items()]
    return spark.createDataFrame(rows, "class_id int, class_name string, is_rock boolean")


def area_statistics(df: DataFrame, label: str, pixel: float = 20.0) -> DataFrame:
    """(class_id, class_name, pixels, km2, percent) of rocks, always all seven, and of masks present.

    ``percent`` is the share of all rock and null for masks.
    """
    counts = df.groupBy(F.col(label).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    classes = F.broadcast(class_dimension(df.sparkSession)).join(counts, "class_id", "left").filter("is_rock or n is not null")
    n = F.coalesce("n", F.lit(0))
    # Twelve rows at most, so one window over all of them is no bottleneck.
    rock = F.sum(F.when(F.col("is_rock"), n).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    percent = F.when(F.col("is_rock"), F.when(rock > 0, 100.0 * n / rock).otherwise(0.0))
    return classes.select("class_id", "class_name", n.cast("long").alias("pixels"), (n * (pixel * pixel / 1e6)).alias("km2"), percent.alias("percent"))


def zonal_histogram(df: DataFrame, zone: str, label: str) -> DataFrame:
    return df.groupBy(zone, label).agg(F.count(F.lit(1)).alias("pixels"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """(truth, predicted, n) for all pairs of classes, zeros included; other ids are left out."""
    spark = df.sparkSession
    ids = spark.createDataFrame([(k,) for k in classes], "k int")
    pairs = ids.select(F.col("k").alias("truth")).crossJoin(ids.select(F.col("k").alias("predicted")))
    counts = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(pairs).join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """(n, overall, kappa, macro_f1) of a confusion matrix; macro F1 is over classes with support."""
    rows = matrix.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    columns = matrix.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("called"))
    each = rows.join(columns, "k")
    f1 = F.when(F.col("support") + F.col("called") > 0, 2.0 * F.col("hit") / (F.col("support") + F.col("called"))).otherwise(0.0)
    total = each.agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("support").cast("double") * F.col("called")).alias("chance"),
        F.avg(F.when(F.col("support") > 0, f1)).alias("macro_f1"),
    )
    overall = F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0)
    expected = F.when(F.col("n") > 0, F.col("chance") / (F.col("n").cast("double") * F.col("n"))).otherwise(0.0)
    kappa = F.when(expected < 1, (overall - expected) / (1 - expected)).otherwise(0.0)
    return total.select(F.col("n").cast("long").alias("n"), overall.alias("overall"), kappa.alias("kappa"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def robust_scales(df: DataFrame, columns: dict[str, Column], floor: float = 1e-3) -> DataFrame:
    """One row of ``{name}_median`` and ``{name}_scale`` (1.4826 times the median deviation, floored)."""
    return selection.robust_row(df, columns, floor)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Joins a single row of statistics to every row."""
    return df.crossJoin(F.broadcast(one_row))


def z_stats(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row of mean and population deviation (plus 1e-6) of each column."""
    aggs = [x for k, v in columns.items() for x in (F.avg(v).alias(f"{k}_mean"), (F.stddev_pop(v) + 1e-6).alias(f"{k}_std"))]
    return df.agg(*aggs)


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


#: Slices of scores within which occurrences are ranked.
SLICES = 1024


def success_rates(occurrences: DataFrame, background: DataFrame, score: str = "score") -> DataFrame:
    """(n, auc, top10, top20): where occurrences stand among background scores.

    Both sides are ranked in one sort by score, not compared pair by pair.
    """
    both = occurrences.select(F.col(score).alias("s"), F.lit(1).alias("is_occ")).unionByName(background.select(F.col(score).alias("s"), F.lit(0).alias("is_occ"))).filter("s is not null and not isnan(s)")
    levels = both.groupBy("s").agg(F.sum(1 - F.col("is_occ")).alias("bg"), F.sum("is_occ").alias("occ"))
    # Summed within slices of the scores; the slices before one are summed over ``SLICES`` rows.
    ends = both.agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"), F.sum(1 - F.col("is_occ")).alias("n_bg"))
    slice_of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(SLICES - 1), F.floor((F.col("s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SLICES))).otherwise(0)
    sliced = with_row(levels, ends.select("_lo", "_hi")).withColumn("_slice", slice_of).drop("_lo", "_hi")
    sums = sliced.groupBy("_slice").agg(F.sum("bg").alias("_bg"))
    before = F.sum("_bg").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("bg").over(Window.partitionBy("_slice").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    below = sliced.withColumn("_within", within).join(F.broadcast(offsets), "_slice").withColumn("upto", F.col("_before") + F.col("_within"))
    size = ends.select("n_bg")
    placed = with_row(below.filter("occ > 0"), size).filter("n_bg > 0").withColumn("pct", F.col("upto") / F.col("n_bg"))
    share = lambda cut: F.sum(F.when(F.col("pct") >= cut, F.col("occ")).otherwise(0)) / F.sum("occ")
    return placed.agg(F.coalesce(F.sum("occ"), F.lit(0)).cast("long").alias("n"), (F.sum(F.col("pct") * F.col("occ")) / F.sum("occ")).alias("auc"), share(0.9).alias("top10"), share(0.8).alias("top20"))


def target_cutoff(df: DataFrame, scores: dict[str, Column], floor: float = 75.0, share: float = 0.99) -> DataFrame:
    """One row of scores from which ground is a target: the top percentile of each, within ``floor`` and 99."""
    top = selection.quantile_row(df, {k: (v, share) for k, v in scores.items()})
    return top.select(*[F.least(F.lit(99.0), F.greatest(F.lit(floor), F.coalesce(k, F.lit(100.0)))).alias(k) for k in scores])
