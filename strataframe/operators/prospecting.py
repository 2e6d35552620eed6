"""From scores of models to targets, areas and how well known occurrences are found."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import window_max
from .statistics import success_rates, target_cutoff
from .targets import apart, component_statistics, connected, settled

#: Score from which ground counts as high, least pixels of a target, distance between targets, targets of a model.
HIGH, LEAST_PIXELS, APART_M, MOST_TARGETS = 75.0, 12, 500.0, 50
OVERALL = "overall"


@dataclass
class Prospects:
    """``models``: a row for each model and for the best of all (``overall``): high_km2, cutoff, targets, and n, auc, top10, top20
    of known occurrences.  ``targets``: numbered from the best, apart from each other within a model, in pixel coordinates."""

    models: DataFrame
    targets: DataFrame


def prospects(scores: DataFrame, models: list[str], width: int, occurrences: DataFrame | None = None, usable: str = "usable", pixel: float = 20.0, least: int = LEAST_PIXELS, distance: float = APART_M, most: int = MOST_TARGETS) -> Prospects:
    """What comes of scores (r, c, usable, a column for each model, perhaps dem).

    A model's targets are areas that touch by sides or corners where usable ground reaches its
    cutoff, the top percentile within 75 and 99.  ``occurrences`` (key, r, c, model) are
    scored by the best cell around them, each for its own model and all for the best;
    those off the raster don't count.  A null score counts as 0.
    """
    ok = F.coalesce(F.col(usable), F.lit(False))
    held = scores.select("r", "c", ok.alias("_ok"), *[F.when(ok, F.coalesce(m, F.lit(0.0))).otherwise(0.0).alias(m) for m in models], *(["dem"] if "dem" in scores.columns else []))
    held = settled(held.withColumn(OVERALL, F.greatest(*models) if len(models) > 1 else F.col(models[0])))
    ground = held.filter("_ok")
    cuts = target_cutoff(ground, {m: F.col(m) for m in models}, HIGH).first()
    names = [OVERALL, *models]
    high = ground.agg(*[(F.count_if(F.col(m) >= HIGH) * (pixel * pixel / 1e6)).alias(m) for m in names]).first()

    found = []
    for m in models:
        cells = held.filter(F.col("_ok") & (F.col(m) >= cuts[m])).select("r", "c", F.col(m).alias("_score"), F.lit(m).alias("_model"), *(["dem"] if "dem" in held.columns else []))
        areas = settled(connected(cells, width))
        one = component_statistics(areas, "_score", "_model", least, pixel * pixel / 1e4).withColumnRenamed("kind", "model")
        if "dem" in held.columns:
            one = one.join(areas.groupBy("component").agg(F.avg("dem").alias("elevation")), "component")
        found.append(one)
    every = reduce(DataFrame.unionByName, found)
    metres = every.withColumns({"x": F.col("x") * pixel, "y": F.col("y") * pixel})
    kept = apart(metres, "model", distance, most).withColumns({"x": F.col("x") / pixel, "y": F.col("y") / pixel})
    rows = sorted(kept.collect(), key=lambda t: (-t.rank_score, t.model, t.component))  # ``most`` a model
    spark = scores.sparkSession
    schema = ", ".join(["id int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)])
    targets = spark.createDataFrame([(k, *t) for k, t in enumerate(rows, 1)], schema)

    met = None
    if occurrences is not None:
        points = occurrences.select("key", "r", "c", "model")
        there = points.join(held.select("r", "c"), ["r", "c"], "left_semi")
        met = there.select("key", "model")
        for m in names:
            met = met.join(window_max(there, held, m, "key"), "key")
        met = settled(met)
    report = []
    for m in names:
        rates = (None,) * 4
        if met is not None:
            own = met if m == OVERALL else met.filter(F.col("model") == m)
            rates = tuple(success_rates(own.select(F.col(m).alias("score")), ground.select(F.col(m).alias("score"))).first())
        report.append((m, float(high[m] or 0.0), None if m == OVERALL else float(cuts[m]), sum(m in (OVERALL, t.model) for t in rows), *rates))
    return Prospects(spark.createDataFrame(report, "model string, high_km2 double, cutoff double, targets int, n long, auc double, top10 double, top20 double"), targets)
