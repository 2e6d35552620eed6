"""Kernel machines and model bundles against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import bundle, learning, svm


def blobs(seed=2, n=240, spread=0.7, kinds=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, kinds, n)
    centres = rng.normal(0, 2, (kinds, 3))
    return centres[y] + rng.normal(0, spread, (n, 3)), y


@pytest.mark.parametrize("cost", [0.5, 10.0])
def test_dual_solution_is_the_optimum(cost):
    """On 500 rows: what holds of the one optimum and of no other point, from the whole kernel matrix."""
    x, y = blobs(n=500, spread=1.5, kinds=2)
    side, limits = np.where(y == 0, 1.0, -1.0), np.where(y == 0, cost, cost / 2)
    weight, offset = svm.solve(x, side, limits, 0.4, 1e-6)
    margin = side * (svm.kernel(x, x, 0.4) @ (weight * side) + offset)
    assert abs((weight * side).sum()) < 1e-9 and (weight >= 0).all() and (weight <= limits).all()
    assert (margin[weight <= 0] >= 1 - 1e-5).all() and (margin[weight >= limits] <= 1 + 1e-5).all()
    assert np.allclose(margin[(weight > 0) & (weight < limits)], 1, atol=1e-5)


def test_solver_with_a_small_cache(monkeypatch):
    x, y = blobs(n=120, kinds=2)
    side, limits = np.where(y == 0, 1.0, -1.0), np.full(120, 10.0)
    whole = svm.solve(x, side, limits, 0.4)
    monkeypatch.setattr(svm, "CACHE_BYTES", 3000)
    again = svm.solve(x, side, limits, 0.4)
    assert np.allclose(whole[0], again[0]) and abs(whole[1] - again[1]) < 1e-9


def test_machine_votes_and_chances(spark):
    x, y = blobs(spread=0.5)
    df = spark.createDataFrame([(k, int(c) + 4, *map(float, v)) for k, (v, c) in enumerate(zip(x, y))] + [(999, 4, None, 0.0, 0.0)], "id long, kind int, a double, b double, c double").repartition(4)
    machine = svm.fit(df, ["a", "b", "c"], "kind", "id")
    rows = machine.predict(df.withColumn("class", F.lit("old"))).collect()
    known = [r for r in rows if r.a is not None]
    assert len(rows) == 241 and sum(r["class"] == r.kind for r in known) > 225
    assert all(r["class"] is None and r.chances is None for r in rows if r.a is None)
    for r in known[:40]:
        z = (np.array([[r.a, r.b, r.c]]) - machine.mean) / machine.deviation
        clear = np.array([[(machine.weights[k] * np.exp(-machine.gamma * ((machine.vectors - z) ** 2).sum(axis=1))).sum() + machine.offsets[k]] for k in range(3)])[:, 0]
        votes, sums = np.zeros(3), np.zeros(3)
        for (p, q), v in zip([(0, 1), (0, 2), (1, 2)], clear):
            votes[p if v > 0 else q] += 1
            sums[p] += v
            sums[q] -= v
        d = votes + sums / (3 * (np.abs(sums) + 1))
        assert np.allclose(machine.decisions(z)[0], d) and abs(sum(r.chances) - 1) < 1e-12
        assert r["class"] == d.argmax() + 4 and np.allclose(r.chances, np.exp(2 * (d - d.max())) / np.exp(2 * (d - d.max())).sum())
    few = svm.candidates(df.withColumn("label", F.col("kind")), "label", "id", 60)
    assert 50 <= few.count() <= 60 and few.select("label").distinct().count() == 3
    with pytest.raises(ValueError, match="missing"):
        machine.predict(df.drop("a"))
    one = svm.fit(df.filter("kind = 4"), ["a", "b"], "kind", "id")
    assert one.predict(df.dropna()).filter("class = 4").count() == 240


def scene(spark, h=32, w=32):
    r, c = np.mgrid[:h, :w]
    kind = np.array([1, 4, 6])[(r // 8 + c // 8) % 3]
    rng = np.random.default_rng(3)
    rows = [(int(i), int(j), int(i * w + j), float(kind[i, j] / 6 + rng.normal(0, 0.05)), float(rng.normal(0, 1)), int(kind[i, j]) if (i + j) % 9 else None, int((i // 8 * 5 + j // 8) % 5 == 0) * 2) for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "r long, c long, id long, x double, z double, label int, split int").repartition(4)


def test_bundle_is_fitted_saved_and_loaded(spark, tmp_path):
    df = scene(spark).cache()
    made = bundle.fit(df, ["x", "z"], "label", "id", trees=10, net={"rounds": 4, "width": 4})
    assert [m["algorithm"] for m in made.metrics] == ["rf", "svm", "cnn"] and made.classes == [1, 4, 6]
    assert made.best() == max(made.metrics, key=lambda m: m["kappa"])["algorithm"] and max(m["kappa"] for m in made.metrics) > 0.8
    root = str(tmp_path / "models")
    made.save(spark, f"{root}/model_v2")
    again = bundle.load(spark, f"{root}/model_v2")
    assert (again.features, again.classes, again.metrics) == (made.features, made.classes, made.metrics)
    for name in made.models:
        a, b = ({(x.r, x.c): (x["class"], round(x.confidence, 9)) for x in m.predict(df, name).collect()} for m in (made, again))
        assert a == b and len(a) == 32 * 32
    with pytest.raises(ValueError, match="missing"):
        again.predict(df.drop("z"))
    with pytest.raises(ValueError, match="no 'tree'"):
        again.predict(df, "tree")
    with pytest.raises(ValueError, match="too few"):
        bundle.fit(df.limit(40).withColumn("split", F.lit(0)), ["x"], "label", "id")
    names = ["model_v10", "model_v2", "other"]
    assert bundle.whole_versions(spark, root, names) == ["model_v2"] and bundle.current_version(spark, root, names) == "model_v2"
    Bundle = type(made)
    Bundle(made.features, made.classes, {}, made.metrics).save(spark, f"{root}/model_v10")
    assert bundle.current_version(spark, root, names) == "model_v10"
    bundle.set_current(spark, root, "model_v2")
    assert bundle.current_version(spark, root, names) == "model_v2"
    with pytest.raises(ValueError, match="whole"):
        bundle.set_current(spark, root, "model_v3")


def test_fits_read_rows_in_parts_for_every_core(spark):
    """A table read as one part is dealt out, all rows in it and repeated ones too."""
    df = spark.range(4000).selectExpr("cast(id % 500 as double) as v", "cast(id % 2 as double) as y", "id as other").coalesce(1)
    got = learning.dealt(df, ["v", "y"])
    sizes = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
    assert got.columns == ["v", "y"] and sorted(got.collect()) == sorted(df.select("v", "y").collect())
