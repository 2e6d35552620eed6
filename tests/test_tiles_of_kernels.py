"""Halo tiles and the convolution network against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import convnet, halos, learning, spatial
from strataframe.plans.region import Region


def frame(spark, **arrays):
    h, w = next(iter(arrays.values())).shape
    rows = [(r, c, *(None if np.isnan(a[r, c]) else float(a[r, c]) for a in arrays.values())) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "r long, c long, " + ", ".join(f"{k} double" for k in arrays)).repartition(5)


@pytest.mark.parametrize(("edge", "mode"), [("symmetric", "symmetric"), ("reflect", "reflect"), ("none", None)])
@pytest.mark.parametrize("tile", [4, 7, 64])
def test_tiles_see_their_neighbours(spark, edge, mode, tile):
    a = np.random.default_rng(2).normal(0, 1, (13, 18))
    padded = np.pad(a, 3, mode=mode) if mode else np.pad(a, 3, constant_values=np.nan)

    def make(here, arrays):
        want = padded[here.row : here.row + here.height + 6, here.col : here.col + here.width + 6]
        same = np.array_equal(arrays["v"], want, equal_nan=True)
        return halos.cells(here, {"ok": np.full((here.height, here.width), same)})

    out = halos.over_tiles(frame(spark, v=a), ["v"], 3, "r long, c long, ok boolean", make, (13, 18), edge, tile).collect()
    assert len(out) == 13 * 18 and len({(x.r, x.c) for x in out}) == 13 * 18 and all(x.ok for x in out)


def test_patch_sums_of_a_raster_with_gaps(spark):
    a = np.random.default_rng(4).normal(0, 1, (9, 11))
    weights = {(dr, dc): 1.0 + dr * 5 + dc for dr in range(-2, 3) for dc in range(-2, 3)}
    padded = np.pad(a, 2, mode="reflect")
    want = {(r, c): sum(w * padded[r + 2 + dr, c + 2 + dc] for (dr, dc), w in weights.items()) for r in range(9) for c in range(11)}
    got = {(x.r, x.c): x.s for x in halos.patch_sums(frame(spark, v=a), "v", weights, "s").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    a[4, 5] = np.nan
    got = {(x.r, x.c): x.s for x in halos.patch_sums(frame(spark, v=a), "v", weights, "s").collect()}
    assert (4, 5) not in got and got[4, 4] is None and got[0, 0] is not None
    assert halos.patch_sums(frame(spark, v=a).limit(0), "v", weights, "s").count() == 0


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    w, x, y, share = convnet.initial(3, 4, 5), rng.normal(0, 1, (12, 13, 3)), rng.integers(-1, 4, (4, 5)), np.array([1, 2, 0.5, 1.0])
    _, grad = convnet.loss_and_gradient(w, x, y, share)
    for k in range(len(w)):
        for _ in range(4):
            i, step, losses = tuple(rng.integers(s) for s in w[k].shape), 1e-6, []
            for sign in (1, -1):
                w[k][i] += sign * step
                losses.append(convnet.loss_and_gradient(w, x, y, share)[0])
                w[k][i] -= sign * step
            assert abs((losses[0] - losses[1]) / (2 * step) - grad[k][i]) < 1e-6


def test_gradient_stays_in_single_precision():
    rng = np.random.default_rng(3)
    weights, x, y = convnet.initial(3, 4, 5), rng.normal(size=(17, 13, 3)), rng.integers(-1, 4, (9, 5))
    loss, want = convnet.loss_and_gradient(weights, x, y, np.array([1.0, 2.0, 0.5, 1.0]))
    single, got = convnet.loss_and_gradient([w.astype(np.float32) for w in weights], x.astype(np.float32), y, np.array([1.0, 2.0, 0.5, 1.0]))
    assert abs(single - loss) < 1e-4 and {g.dtype for g in got} == {np.dtype(np.float32)}
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, want, strict=True))


def test_dense_scores_are_those_of_each_patch(spark):
    rng = np.random.default_rng(1)
    net = convnet.ConvNet([2, 5, 9], ["a", "b"], [0.1, 0.2], [1.5, 0.7], convnet.initial(2, 3, 4, seed=3))
    a, b = rng.normal(0, 1, (2, 12, 15))
    x = np.pad((np.stack([a, b], axis=2) - net.mean) / net.deviation, ((4, 4), (4, 4), (0, 0)), mode="reflect")
    for tile in (5, 128):
        rows = net.predict(frame(spark, a=a, b=b), tile).collect()
        assert len(rows) == 12 * 15
        for row in rows:
            p = convnet.chances(net.weights, x[row.r : row.r + 9, row.c : row.c + 9])[0, 0]
            assert np.allclose(row.chances, p) and abs(sum(row.chances) - 1) < 1e-12 and row["class"] == net.classes[p.argmax()] and abs(row.confidence - p.max()) < 1e-12
    with pytest.raises(ValueError, match="missing"):
        net.predict(frame(spark, a=a))
    a[3, 3] = np.nan
    assert net.predict(frame(spark, a=a, b=b)).count() == 12 * 15 - 1


def test_network_learns_texture_where_single_cells_tell_nothing(spark):
    """Stripes along rows or columns: every cell is as often dark as bright in both classes."""
    h = w = 64
    r, c = np.mgrid[:h, :w]
    kind = (r // 16 + c // 16) % 2
    v = np.where(kind == 0, r % 2, c % 2) * 2.0 - 1 + np.random.default_rng(5).normal(0, 0.2, (h, w))
    df = frame(spark, v=v, k=kind.astype(float) + 3).withColumn("held", (F.floor(F.col("r") / 16) * 3 + F.floor(F.col("c") / 16)) % 4 == 1)
    net = convnet.fit(df.withColumn("y", F.when(~F.col("held"), F.col("k"))), ["v"], "y", width=8, rounds=25, rate=1e-2)
    met = net.predict(df).join(df.filter("held").select("r", "c", "k"), ["r", "c"])
    assert met.select(F.avg((F.col("class") == F.col("k")).cast("double"))).first()[0] > 0.85
    single = learning.perceptron(df.filter("not held").withColumn("y", F.col("k") - 3), ["v"], "y", 2).transform(df.filter("held"))
    assert single.select(F.avg((F.col("prediction") == F.col("k") - 3).cast("double"))).first()[0] < 0.65
    with pytest.raises(ValueError, match="label"):
        convnet.fit(df.withColumn("y", F.lit(None).cast("int")), ["v"], "y")


def test_kernels_share_one_shuffle_and_are_right(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, (2, 17, 23))
    a[5, 7] = np.nan
    df = frame(spark, a=a, b=b)
    kernels = [halos.mean("m", "a", 5), halos.extreme("hi", "a", 3, "max"), halos.extreme("lo", "b", 7, "min"), halos.slopes("dx", "dy", "b", 2.0), halos.steepness("st", "b")]
    made = halos.with_kernels(df, kernels, tile=6)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(x.r, x.c): x for x in made.collect()}
    assert len(got) == 17 * 23 and made.columns == ["r", "c", "a", "b", "m", "hi", "lo", "dx", "dy", "st"]
    pad = lambda x, n: np.pad(x, n, mode="symmetric")
    pa_, p3, q3, q1 = pad(a, 2), pad(a, 1), pad(b, 3), pad(b, 1)
    gy, gx = np.gradient(b, 2.0)
    for (r, c), x in got.items():
        assert abs(x.m - np.nanmean(pa_[r : r + 5, c : c + 5])) < 1e-12 and x.hi == np.nanmax(p3[r : r + 3, c : c + 3]) and x.lo == q3[r : r + 7, c : c + 7].min()
        assert abs(x.dx - gx[r, c]) < 1e-12 and abs(x.dy - gy[r, c]) < 1e-12
        w = q1[r : r + 3, c : c + 3]
        sx, sy = (w[:, 2] - w[:, 0]) @ [1, 2, 1], (w[2] - w[0]) @ [1, 2, 1]
        assert abs(x.st - np.hypot(sx, sy)) < 1e-12
        assert x.a == a[r, c] or x.a is None


@pytest.mark.parametrize(("steps", "lines"), [(64, 32), (2, 3), (0, 1)])
def test_distances_near_and_far(spark, monkeypatch, steps, lines):
    monkeypatch.setattr(spatial, "STEPS", steps)
    monkeypatch.setattr(spatial, "LINES", lines)
    rng = np.random.default_rng(steps)
    near, far = (rng.random((11, 40)) < 0.05).astype(float), np.zeros((11, 40))
    far[2, 3] = 1
    df = frame(spark, n=near, f=far).withColumns({"n": F.col("n") > 0, "f": F.col("f") > 0, "none": F.lit(False), "text": F.lit("k")})
    rows = spatial.distances(df, {"dn": "n", "df": "f", "d0": "none"}, 20.0).collect()
    assert len(rows) == 440
    for x in rows:
        for name, sites in (("dn", near), ("df", far)):
            want = min(np.hypot(x.r - i, x.c - j) for i, j in zip(*np.nonzero(sites))) * 20
            assert abs(x[name] - want) < 1e-9
        assert x.d0 is None and x.text == "k"


def test_distances_along_tall_columns_need_no_frame_anew_for_each_row(spark):
    cells = spark.range(40_000).select((F.col("id") / 2).cast("long").alias("r"), (F.col("id") % 2).alias("c")).withColumn("n", F.col("r") % 7000 == 50)
    found = spatial.distances(cells, {"d": "n"}, 1.0)
    # Spark begins a frame up to the last row anew for each row: time with the square of a column's length.
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    sites = np.arange(50, 20_000, 7000)
    rows = found.collect()
    assert len(rows) == 40_000 and all(x.d == np.abs(sites - x.r).min() for x in rows)


def test_a_fault_raises_veins_and_layers_switch_weights(spark, tmp_path):
    """Along a straight trench veins score higher; quartz and depths count where they are known."""
    rng = np.random.default_rng(0)
    h = w = 48
    r, c = np.mgrid[:h, :w]
    dem = 1000 + rng.normal(0, 0.3, (h, w)) - 150 * np.exp(-((c - r) / 2.0) ** 2)
    bands = {b: 0.2 + 0.02 * rng.random((h, w)) + (0.25 if b != "blue" else 0.2) * ((r // 6 + c // 6) % 2) for b in ("blue", "green", "red", "nir", "swir1", "swir2")}
    df = frame(spark, dem=dem, **bands).withColumn("scl", F.lit(5))
    region = Region(spark, str(tmp_path / "region"), 500000.0, 3900000.0, 43, w, tile=32)
    df.write.parquet(str(tmp_path / "region" / "composite"))
    found = region.lineaments(300.0)
    near = found.filter("line and abs(c - r) <= 4").count()
    assert near > 20 and near > 5 * found.filter("line and abs(c - r) > 12").count()
    plain = region.minerals().cache()
    by_distance = plain.join(found, ["r", "c"]).groupBy((F.abs(F.col("c") - F.col("r")) <= 4).alias("near")).agg(F.avg("vein").alias("v"))
    score = {x.near: x.v for x in by_distance.collect()}
    assert score[True] > score[False]
    layers = frame(spark, quartz_index_raw=1 + 0.01 * rng.random((h, w)) + (c > 40), clay_depth=np.where(r < 10, 0.2, np.nan), iron_depth=np.where(r < 10, 0.0, np.nan))
    plain_rows = {(x.r, x.c): x for x in plain.collect()}
    switched = {(x.r, x.c): x for x in region.minerals(layers=layers, force=True).collect()}
    assert np.mean([switched[k].vein for k in switched if k[1] > 42]) > np.mean([plain_rows[k].vein for k in plain_rows if k[1] > 42])
    assert np.mean([switched[k].copper for k in switched if k[0] < 9]) > np.mean([plain_rows[k].copper for k in plain_rows if k[0] < 9])
    assert all(abs(switched[k].copper - plain_rows[k].copper) < 1e-9 for k in switched if k[0] > 12)
