"""Model bundles: fitted together, compared, saved, loaded and numbered."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import convnet, learning, statistics, svm

#: Least number of labelled pixels to learn from; algorithms in the order of equals.
LEAST_TRAIN, ALGORITHMS = 50, ("rf", "svm", "cnn")
_VERSION = re.compile(r"model_v(\d+)$")


@dataclass
class Bundle:
    """Models by algorithm, the columns they read, their classes, and accuracies (algorithm, n, overall, kappa, macro_f1)."""

    features: list[str]
    classes: list[int]
    models: dict[str, object]
    metrics: list[dict]

    def best(self) -> str:
        """The algorithm of highest kappa, the first by name of equal ones."""
        return min(self.metrics, key=lambda m: (-m["kappa"], m["algorithm"]))["algorithm"]

    def predict(self, df: DataFrame, algorithm: str | None = None) -> DataFrame:
        """(r, c, class, confidence) of every pixel with all features, by the best algorithm unless another is named."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"the bundle was trained on {self.features}; {missing} are missing")
        name = algorithm or self.best()
        if name not in self.models:
            raise ValueError(f"the bundle has no {name!r}, only {sorted(self.models)}")
        known = df.select("r", "c", *self.features)
        if name == "cnn":
            return self.models[name].predict(known).select("r", "c", "class", "confidence")
        known = known.dropna(subset=self.features)
        if name == "svm":
            return self.models[name].predict(known).select("r", "c", "class", "confidence")
        names = F.array(*[F.lit(k) for k in self.classes])
        scored = self.models[name].transform(known)
        return scored.select("r", "c", F.get(names, F.col("prediction").cast("int")).alias("class"), F.array_max(vector_to_array("probability")).alias("confidence"))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Writes models and, last of all, the description, so that a bundle with one is whole."""
        meta = {"features": self.features, "classes": self.classes, "metrics": self.metrics, "algorithms": sorted(self.models)}
        for name, model in self.models.items():
            if name == "rf":
                model.write().overwrite().save(f"{folder}/rf")
            elif name == "svm":
                arrays = {k: (list(np.shape(v)), np.asarray(v, float).ravel().tolist()) for k, v in vars(model).items() if k not in ("classes", "features")}
                _write(spark, f"{folder}/svm", {"classes": model.classes, "features": model.features}, arrays)
            else:
                arrays = {f"w{k}": (list(w.shape), w.ravel().tolist()) for k, w in enumerate(model.weights)}
                _write(spark, f"{folder}/cnn", {k: getattr(model, k) for k in ("classes", "features", "mean", "deviation")}, arrays)
        spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{folder}/meta")


def _write(spark: SparkSession, folder: str, meta: dict, arrays: dict[str, tuple]) -> None:
    rows = [(json.dumps(meta), None, None, None)] + [(None, k, shape, values) for k, (shape, values) in arrays.items()]
    spark.createDataFrame(rows, "meta string, name string, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(folder)


def _read(spark: SparkSession, folder: str) -> tuple[dict, dict[str, np.ndarray]]:
    rows = spark.read.parquet(folder).collect()  # a row an array of a model
    meta = next(json.loads(r.meta) for r in rows if r.meta)
    return meta, {r.name: np.array(r.numbers, float).reshape(r.shape) for r in rows if r.name}


def load(spark: SparkSession, folder: str) -> Bundle:
    meta = json.loads(spark.read.text(f"{folder}/meta").first().value)
    models: dict[str, object] = {}
    for name in meta["algorithms"]:
        if name == "rf":
            models[name] = PipelineModel.load(f"{folder}/rf")
        elif name == "svm":
            own, arrays = _read(spark, f"{folder}/svm")
            models[name] = svm.KernelMachine(own["classes"], own["features"], gamma=float(arrays.pop("gamma")), **arrays)
        else:
            own, arrays = _read(spark, f"{folder}/cnn")
            models[name] = convnet.ConvNet(own["classes"], own["features"], own["mean"], own["deviation"], [arrays[f"w{k}"] for k in range(len(arrays))])
    return Bundle(meta["features"], meta["classes"], models, meta["metrics"])


def fit(df: DataFrame, features: list[str], label: str, key: str, algorithms: tuple[str, ...] = ALGORITHMS, trees: int = 200, seed: int = 0, net: dict | None = None) -> Bundle:
    """All algorithms on pixels (r, c, key, features, label, split) of split 0, compared on those of split 2.

    Without any of split 2 those of split 1 are used.  A null label is one to look at but
    not to learn from.  Fewer than 50 labelled pixels of split 0 are too few.
    """
    unknown = set(algorithms) - set(ALGORITHMS)
    if unknown:
        raise ValueError(f"algorithms {sorted(unknown)} aren't known")
    labelled = df.filter(F.col(label).isNotNull()).dropna(subset=features)
    sizes = {(r["split"], int(r[label])): r["count"] for r in labelled.groupBy("split", label).count().collect()}  # a row a class and split
    classes = sorted(k for s, k in sizes if s == 0)
    n = sum(v for (s, _), v in sizes.items() if s == 0)
    if n < LEAST_TRAIN:
        raise ValueError(f"{n} labelled pixels to learn from are too few: do the labels overlap what can be seen?")
    train = labelled.filter("split = 0")
    test = labelled.filter(F.col("split") == (2 if any(s == 2 for s, _ in sizes) else 1))
    models: dict[str, object] = {}
    for name in algorithms:
        if name == "rf":
            places = F.array(*[F.lit(k) for k in classes])
            models[name] = learning.forest(train.withColumn("_y", (F.array_position(places, F.col(label).cast("int")) - 1).cast("double")), features, "_y", trees, 2, seed)
        elif name == "svm":
            models[name] = svm.fit(train, features, label, key)
        else:
            models[name] = convnet.fit(df.withColumn("_label", F.when(F.col("split") == 0, F.col(label))), features, "_label", seed=seed, **(net or {}))
    made = Bundle(features, classes, models, [])
    for name in algorithms:
        # The network needs the cells around those that are compared.
        met = made.predict(df if name == "cnn" else test, name).join(test.select("r", "c", F.col(label).cast("int").alias("_truth")), ["r", "c"])
        row = statistics.accuracy(statistics.confusion(met, "_truth", "class", sorted({k for _, k in sizes}))).first()
        made.metrics.append({"algorithm": name, "n": row.n, "overall": row.overall, "kappa": row.kappa, "macro_f1": row.macro_f1})
    return made


def whole_versions(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Those of ``names`` (model_v1, model_v2, ...) that lie whole under ``root``, oldest first."""
    found = []
    for name in names:
        if match := _VERSION.match(name):
            try:
                spark.read.text(f"{root}/{name}/meta").first()
                found.append((int(match[1]), name))
            except AnalysisException:
                continue
    return [name for _, name in sorted(found)]


def current_version(spark: SparkSession, root: str, names: list[str]) -> str | None:
    """The version that ``set_current`` named, or the newest whole one if that is gone or was never named."""
    whole = whole_versions(spark, root, names)
    try:
        named = spark.read.text(f"{root}/current").first()
    except AnalysisException:
        named = None
    return named.value if named is not None and named.value in whole else whole[-1] if whole else None


def set_current(spark: SparkSession, root: str, name: str) -> None:
    if not whole_versions(spark, root, [name]):
        raise ValueError(f"{name} is not a whole model under {root}")
    spark.createDataFrame([(name,)], "value string").write.mode("overwrite").text(f"{root}/current")
