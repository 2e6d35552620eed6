"""Classifiers and spectral units with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds a weight by which all classes count the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_total") / (F.col("_classes") * F.col("_n"))).alias(out))
    return df.join(F.broadcast(weights), label)  # one row per class


def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of all rows in equal parts for every core: a compressed table may be read in fewer parts than there are
    cores, and every pass of a fit would run on those few.  Parts are in order, so that draws from them are the same each time."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.select(*columns).repartition(parts).sortWithinPartitions(*columns)


def forest(train: DataFrame, features: list[str], label: str, trees: int = 200, least: int = 2, seed: int = 0) -> PipelineModel:
    """Random forest on class-balanced weights; labels are whole numbers from 0."""
    stages = [VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=least, maxDepth=12, seed=seed)]
    return Pipeline(stages=stages).fit(dealt(balanced(train, label), [*features, label, "weight"]))


def perceptron(train: DataFrame, features: list[str], label: str, classes: int, hidden: int = 24, seed: int = 0) -> PipelineModel:
    """A small network on scaled features of single pixels."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), hidden, classes], maxIter=60, seed=seed),
    ]
    return Pipeline(stages=stages).fit(dealt(train, [*features, label]))


def units(df: DataFrame, features: list[str], k: int = 10, seed: int = 0) -> PipelineModel:
    """k-means over scaled features."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), KMeans(k=k, featuresCol="scaled", predictionCol="unit", seed=seed)]
    return Pipeline(stages=stages).fit(df)


def with_unit_confidence(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``unit`` from 1 and ``confidence``: twice the margin between the two nearest centres, up to 1."""
    centres = [c.tolist() for c in model.stages[-1].clusterCenters()]
    x = vector_to_array("scaled")
    distance = lambda c: F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = F.array_sort(F.array(*[distance(c) for c in centres]))
    margin = F.lit(1.0) - near[0] / (near[1] + 1e-6) if len(centres) > 1 else F.lit(1.0)
    scored = model.transform(df)
    return scored.withColumn("confidence", F.least(F.greatest(margin, F.lit(0.0)) * 2, F.lit(1.0))).withColumn("unit", F.col("unit") + 1)
