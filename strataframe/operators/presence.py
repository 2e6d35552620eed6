"""Models of presence against background: sampling, grouped folds, ranks, forests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import learning
from .sampling import portable_hash
from .selection import values_at
from .targets import settled

#: Background rows for each row of presence, folds, groups that background is dealt to.
PER_PRESENCE, FOLDS, BACKGROUND_GROUPS = 20, 5, 5
#: Slices of hashes and of scores within which rows are ranked.
SLICES = 1024


def lowest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose keys hash lowest, ties by key; all rows if there are fewer.  Rows of one key are told apart by nothing."""
    hashed = settled(df.withColumn("_h", portable_hash(F.col(key))))
    total, at = values_at(hashed.select(F.col("_h").cast("double").alias("_h")), {"_h": lambda m: [n - 1] if 0 < n <= m else []})["_h"]
    if n <= 0:
        return df.limit(0)
    if total < n:
        return hashed.drop("_h")
    cut = int(at[n - 1])
    below = hashed.filter(F.col("_h") < cut)
    # Only rows of one hash are ordered with each other.
    edge = hashed.filter(F.col("_h") == cut).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(key)))
    return below.drop("_h").unionByName(edge.filter(F.col("_n") <= n - below.count()).drop("_h", "_n"))


def deal_folds(groups: DataFrame, group: str, n: str, folds: int = FOLDS) -> DataFrame:
    """(group, fold): groups in order of size, the largest first, dealt to the folds forth and back.

    So folds differ by no more than the largest group.  Ranks come from counts of
    sizes and slices of hashes, and from places within them.
    """
    hashed = groups.select(group, F.col(n).alias("_n")).withColumn("_h", portable_hash(F.abs(F.col(group)), (F.col(group) < 0).cast("long")))
    sliced = hashed.withColumn("_slice", F.shiftright("_h", 21))
    counts = sliced.groupBy("_n", "_slice").agg(F.count(F.lit(1)).alias("_count"))
    before = F.sum("_count").over(Window.orderBy(F.desc("_n"), "_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_n", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_n", "_slice").orderBy("_h", group))
    ranked = sliced.withColumn("_place", place).join(offsets, ["_n", "_slice"])
    turn = (F.col("_before") + F.col("_place") - 1) % (2 * folds)
    return ranked.select(group, F.least(turn, 2 * folds - 1 - turn).cast("int").alias("fold"))


def presence_table(presence: DataFrame, background: DataFrame, group: str, key: str, features: list[str]) -> DataFrame:
    """(key, group, y, features) of all presence rows and at most 20 times as many of the background.

    A presence row's group is its occurrence's, not negative; background falls into five
    groups of its own, -1 to -5, by hash.
    """
    found = settled(presence.select(F.col(key).cast("long").alias("key"), F.col(group).cast("long").alias("group"), *features))
    chosen = lowest_hashes(background.select(F.col(key).cast("long").alias("key"), *features), "key", PER_PRESENCE * found.count())
    apart = chosen.withColumn("group", -1 - portable_hash(F.col("key") + 1) % BACKGROUND_GROUPS)
    return found.withColumn("y", F.lit(1)).unionByName(apart.withColumn("y", F.lit(0)).select("key", "group", *features, "y"))


def with_folds(table: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Adds ``fold``; no group lies in two, and there are no more folds than groups of presence."""
    sizes = table.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y"))
    most = min(folds, sizes.filter("y = 1").count())
    return table.join(deal_folds(sizes, "group", "n", max(1, most)), "group")


def rank_auc(df: DataFrame, fold: str, score: str, y: str = "y") -> DataFrame:
    """(fold, positives, negatives, auc) of each fold with both kinds: the share of pairs in order, half for ties.

    Scores are ranked within slices of their fold's range; slices are summed over
    ``SLICES`` rows a fold.
    """
    levels = df.filter(F.col(score).isNotNull()).groupBy(fold, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("q"))
    levels = settled(levels)
    ends = levels.groupBy(fold).agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(SLICES - 1), F.floor((F.col("s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SLICES))).otherwise(0)
    sliced = levels.join(F.broadcast(ends), fold).withColumn("_slice", at)  # a row a fold
    sums = sliced.groupBy(fold, "_slice").agg(F.sum("q").alias("_q"))
    before = F.coalesce(F.sum("_q").over(Window.partitionBy(fold).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(fold, "_slice", before.alias("_before"))
    within = F.coalesce(F.sum("q").over(Window.partitionBy(fold, "_slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sliced.withColumn("_within", within).join(F.broadcast(offsets), [fold, "_slice"])  # SLICES rows a fold
    below = F.col("_before") + F.col("_within") + F.col("q") / 2.0
    out = ranked.groupBy(fold).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * below).alias("_sum"))
    return out.filter("positives > 0 and negatives > 0").select(fold, "positives", "negatives", (F.col("_sum") / (F.col("positives") * F.col("negatives"))).alias("auc"))


@dataclass
class PresenceModel:
    """A forest over all rows, the accuracy of forests on folds they haven't seen, importances."""

    model: PipelineModel
    folds: DataFrame
    features: list[str]

    def importance(self) -> DataFrame:
        """(feature, importance), the shares by which trees split."""
        rows = list(zip(self.features, map(float, self.model.stages[-1].featureImportances.toArray()), strict=True))
        return self.folds.sparkSession.createDataFrame(rows, "feature string, importance double")

    def code(self, df: DataFrame, usable: Column, out: str = "code") -> DataFrame:
        """Adds the chance of presence in hundredths plus 1, and 0 where ground isn't usable."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} of the model are missing")
        held = df.fillna(0.0, self.features)
        scored = self.model.transform(held).withColumn(out, F.when(usable, F.bround(_chance() * 100) + 1).otherwise(0).cast("int"))
        return scored.select(*[c for c in df.columns if c != out], out)


def _chance() -> Column:
    return vector_to_array("probability")[1]


def fit(table: DataFrame, features: list[str], trees: int = 300, least: int = 3, folds: int = FOLDS, seed: int = 0) -> PresenceModel:
    """Forests on all but one fold each, then one on all rows; classes count the same.

    Folds without both kinds of rows give no accuracy.
    """
    dealt = settled(with_folds(table, folds))
    rows = []
    for k in sorted(r.fold for r in dealt.select("fold").distinct().collect()):  # ``folds`` rows
        train, test = dealt.filter(F.col("fold") != k), dealt.filter(F.col("fold") == k)
        if train.select("y").distinct().count() < 2:
            continue
        scored = learning.forest(train, features, "y", trees, least, seed).transform(test).select("fold", "y", _chance().alias("score"))
        rows += [tuple(r) for r in rank_auc(scored, "fold", "score").collect()]
    found = table.sparkSession.createDataFrame(rows, "fold int, positives long, negatives long, auc double")
    return PresenceModel(learning.forest(dealt, features, "y", trees, least, seed), found, features)
