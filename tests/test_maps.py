"""Polygons, order statistics and presence models against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import polygons, presence, prospecting, selection, targets
from strataframe.plans.region import Region


def grid(spark, values):
    return spark.createDataFrame([(r, c, None if v is None else int(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "r long, c long, label int").repartition(4)


def flood(values, tile=None):
    """Patches of one label by sides: {first pixel: cells}."""
    h, w, seen, out = len(values), len(values[0]), set(), {}
    for r in range(h):
        for c in range(w):
            if (r, c) in seen or values[r][c] is None:
                continue
            patch, todo = set(), [(r, c)]
            while todo:
                a, b = todo.pop()
                if (a, b) in patch:
                    continue
                patch.add((a, b))
                for x, y in ((a, b + 1), (a, b - 1), (a + 1, b), (a - 1, b)):
                    if 0 <= x < h and 0 <= y < w and values[x][y] == values[r][c] and (not tile or (x // tile, y // tile) == (a // tile, b // tile)):
                        todo.append((x, y))
            seen |= patch
            out[min(patch)[0] * w + min(patch)[1]] = patch
    return out


def signed(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2


def inside(x, y, ring):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:])) % 2 == 1


@pytest.mark.parametrize(("shape", "kinds", "tile"), [((12, 15), 2, None), ((14, 11), 3, 5)])
def test_polygons_are_the_patches(spark, shape, kinds, tile):
    rng = random.Random(sum(shape))
    values = [[rng.choice([*range(1, kinds + 1), None] if c < 2 else range(1, kinds + 1)) for c in range(shape[1])] for _ in range(shape[0])]
    want = flood(values, tile)
    rows = polygons.polygonise(grid(spark, values), "label", shape[1], tile).collect()
    assert {x.component for x in rows} == set(want)
    for x in rows:
        cells = want[x.component]
        assert x.pixels == len(cells) and x.holes == len(x.rings) - 1 and x.label == values[min(cells)[0]][min(cells)[1]]
        assert signed(x.rings[0]) > 0 and all(signed(q) < 0 for q in x.rings[1:]) and sum(map(signed, x.rings)) == len(cells)
        for ring in x.rings:
            assert ring[0] == ring[-1] and len({tuple(p) for p in ring}) == len(ring) - 1  # no ring passes a corner twice
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:]))
        held = {(r, c) for r in range(shape[0]) for c in range(shape[1]) if inside(c + 0.5, r + 0.5, x.rings[0]) and not any(inside(c + 0.5, r + 0.5, q) for q in x.rings[1:])}
        assert held == cells


def test_polygons_of_a_ring_in_a_ring_and_of_nothing(spark):
    values = [[1] * 7, [1, 2, 2, 2, 2, 2, 1], [1, 2, 1, 1, 1, 2, 1], [1, 2, 1, 3, 1, 2, 1], [1, 2, 1, 1, 1, 2, 1], [1, 2, 2, 2, 2, 2, 1], [1] * 7]
    rows = {x.component: x for x in polygons.polygonise(grid(spark, values), "label", 7).collect()}
    assert {k: (x.pixels, x.holes) for k, x in rows.items()} == {0: (24, 1), 8: (16, 1), 16: (8, 1), 24: (1, 0)}
    assert rows[24].rings == [[[3.0, 3.0], [4.0, 3.0], [4.0, 4.0], [3.0, 4.0], [3.0, 3.0]]]
    assert polygons.polygonise(grid(spark, values).limit(0), "label", 7).count() == 0


def test_region_writes_class_polygons(spark, tmp_path):
    rng = random.Random(9)
    values = [[250 if rng.random() < 0.1 else 1 + (r // 8 + c // 8) % 3 if rng.random() < 0.9 else 7 for c in range(32)] for r in range(24)]
    region = Region(spark, str(tmp_path / "region"), 500000.0, 3900000.0, 43, 32, tile=16)
    grid(spark, values).write.parquet(str(tmp_path / "region" / "classes"))
    region.export_polygons(str(tmp_path / "out"), least=6)
    features = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()]
    rock = [[v if v < 250 else None for v in row] for row in values]
    kept = targets.sieve(grid(spark, rock).filter("label is not null"), "label", 32, 6, "kept").collect()
    after = [[None] * 32 for _ in range(24)]
    for x in kept:
        after[x.r][x.c] = x.kept
    want = sorted((after[k // 32][k % 32], len(cells), f"{k % 32 // 16:03d}_{k // 32 // 16:03d}") for k, cells in flood(after, 16).items())
    assert sorted((f["properties"]["class_id"], f["properties"]["pixels"], f["properties"]["tile"]) for f in features) == want
    for f in features:
        assert f["geometry"]["type"] == "Polygon" and f["properties"]["lithology"] and abs(f["properties"]["area_ha"] - f["properties"]["pixels"] * 0.04) < 1e-9
        ring = np.array(f["geometry"]["coordinates"][0])
        assert (abs(ring[:, 0] - 75.0) < 0.01).all() and (abs(ring[:, 1] - 35.24) < 0.01).all()
    assert region.polygons(least=1, masks=True).agg(F.sum("pixels")).first()[0] == 24 * 32


VALUES = {
    "spread": np.random.default_rng(1).normal(0, 1, 4000).tolist(),
    "ties": [float(k % 7) for k in range(1000)],
    "steep": [10.0 ** (-k) for k in range(30)] + [-(10.0 ** (k % 20)) for k in range(60)],
    "wide": [1.7e308, -1.7e308, 0.0, 1.0, 5e-324, -5e-324],
    "one": [3.25],
    "none": [],
    "odd": [math.nan, math.inf, -math.inf, 2.0, 1.0, None],
}


@pytest.mark.parametrize("bins", [2, 4096])
def test_order_statistics_are_exact(spark, monkeypatch, bins):
    """Every rank comes out, with bins so few that many passes are needed, too."""
    monkeypatch.setattr(selection, "BINS", bins)
    size = max(map(len, VALUES.values()))
    rows = [tuple(v[k] if k < len(v) else None for v in VALUES.values()) for k in range(size)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in VALUES)).repartition(3).cache()
    which = lambda n: sorted({0, n // 7, n // 2, n - 1})
    found = selection.values_at(df, {k: which for k in VALUES})
    for k, v in VALUES.items():
        ordered = sorted((x for x in v if x is not None), key=lambda x: (math.isnan(x), x))
        n, at = found[k]
        assert n == len(ordered) and all(repr(at[i]) == repr(ordered[i]) for i in which(n) if n)
    shares = [0.0, 0.02, 0.5, 0.985, 1.0]
    got = selection.quantiles(df, {"spread": shares, "ties": shares, "none": shares})
    for k in ("spread", "ties"):
        assert got[k] == list(df.agg(*[F.percentile(k, p) for p in shares]).first())
    assert got["none"] == [None] * 5


def test_robust_row_is_that_of_exact_medians(spark):
    df = spark.createDataFrame([(x, y) for x, y in zip(VALUES["spread"], [None, *map(abs, VALUES["spread"][1:])])], "a double, b double")
    got = selection.robust_row(df, {"a": F.col("a"), "b": F.col("b") * 2, "c": F.lit(None).cast("double")}, 1e-3).first()
    for name, values in (("a", np.array(VALUES["spread"])), ("b", 2 * np.abs(VALUES["spread"][1:]))):
        assert abs(got[f"{name}_median"] - np.median(values)) < 1e-12
        assert abs(got[f"{name}_scale"] - 1.4826 * np.median(np.abs(values - np.median(values)))) < 1e-12
    assert (got.c_median, got.c_scale) == (0.0, 1.0)


def test_no_reducer_sees_all_values(spark):
    """What is shuffled in a pass is a row for each bin, not for each value."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    bins = selection._pass(df, [("v", 0.0, 200_002.0)])[0]
    assert len(bins) <= selection.BINS and sum(n for n, _, _ in bins.values()) == 200_000 and max(n for n, _, _ in bins.values()) < 100


def sample(spark, n_groups=12, n_background=900, seed=3):
    rng = np.random.default_rng(seed)
    pos = [(int(k), int(g), *map(float, rng.normal(1.2, 1, 3))) for k, g in enumerate(np.repeat(np.arange(n_groups), rng.integers(1, 9, n_groups)))]
    back = [(int(k), *map(float, rng.normal(0, 1, 3))) for k in range(1000, 1000 + n_background)]
    return spark.createDataFrame(pos, "id long, g long, x double, y2 double, z double"), spark.createDataFrame(back, "id long, x double, y2 double, z double"), len(pos)


def test_background_is_bounded_and_repeatable(spark):
    _, back, _ = sample(spark)
    got = [x.id for x in presence.lowest_hashes(back, "id", 50).collect()]
    assert len(set(got)) == 50 and sorted(got) == sorted(x.id for x in presence.lowest_hashes(back.repartition(7), "id", 50).collect())
    assert presence.lowest_hashes(back, "id", 5000).count() == 900 and presence.lowest_hashes(back, "id", 0).count() == 0
    assert presence.lowest_hashes(back.unionByName(back), "id", 51).count() == 51


def test_no_group_lies_in_two_folds(spark):
    pos, back, n = sample(spark, 12, 4000)
    table = presence.presence_table(pos, back, "g", "id", ["x", "y2", "z"])
    assert table.filter("y = 0").count() == min(4000, 20 * n) and table.filter("y = 1").count() == n
    dealt = presence.with_folds(table)
    assert dealt.groupBy("group").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert dealt.select("fold").distinct().count() == 5 and dealt.count() == table.count()
    sizes = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= max(r["count"] for r in dealt.groupBy("group").count().collect())
    few = presence.with_folds(presence.presence_table(pos.filter("g < 2"), back, "g", "id", ["x"]))
    assert few.select("fold").distinct().count() == 2


def test_auc_is_the_share_of_pairs_in_order(spark):
    rng = random.Random(8)
    rows = [(k % 3, rng.choice([0.1, 0.2, rng.random()]), int(rng.random() < 0.3)) for k in range(400)] + [(7, 0.5, 1), (8, 0.5, 0), (9, 1.0, 1), (9, 1.0, 0), (0, None, 1)]
    got = {x.fold: x for x in presence.rank_auc(spark.createDataFrame(rows, "fold int, s double, y int").repartition(4), "fold", "s").collect()}
    assert set(got) == {0, 1, 2, 9}
    for k, x in got.items():
        p, q = [s for f, s, y in rows if f == k and y and s is not None], [s for f, s, y in rows if f == k and not y]
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
        assert (x.positives, x.negatives) == (len(p), len(q)) and abs(x.auc - want) < 1e-12


def test_presence_model_finds_what_is_there(spark):
    pos, back, _ = sample(spark)
    features = ["x", "y2", "z"]
    made = presence.fit(presence.presence_table(pos, back.withColumn("x", F.col("x") * 1.0), "g", "id", features), features, trees=15)
    folds = made.folds.collect()
    assert len(folds) >= 3 and sum(x.auc for x in folds) / len(folds) > 0.75
    assert abs(sum(x.importance for x in made.importance().collect()) - 1) < 1e-9
    coded = made.code(back.withColumn("ok", F.col("id") % 2 == 0), F.col("ok")).collect()
    assert all((x.code == 0) == (not x.ok) and x.code <= 101 for x in coded)
    with pytest.raises(ValueError, match="missing"):
        made.code(back.drop("z"), F.lit(True))


def test_prospects_from_scores_to_targets(spark):
    """Two blocks of high scores and one too small; occurrences on and off them, and off the raster."""
    rng = random.Random(4)
    score = {(r, c): rng.uniform(0, 60) for r in range(40) for c in range(50)}
    for r0, c0, size, value in ((2, 3, 5, 97), (30, 40, 4, 92), (20, 20, 2, 99)):
        score |= {(r0 + i, c0 + j): value + rng.random() / 10 for i in range(size) for j in range(size)}
    df = spark.createDataFrame([(r, c, c != 49, v, 10.0, 100.0 * r) for (r, c), v in score.items()], "r long, c long, usable boolean, iron double, vein double, dem double").repartition(4)
    points = spark.createDataFrame([(1, 4, 4, "iron"), (2, 10, 10, "vein"), (3, 90, 4, "iron")], "key long, r long, c long, model string")
    made = prospecting.prospects(df, ["iron", "vein"], 50, points, distance=100.0)
    rows = {x.model: x for x in made.models.collect()}
    ground = sorted(v for (r, c), v in score.items() if c != 49)
    cut = min(99.0, max(75.0, float(np.percentile(ground, 99))))
    assert abs(rows["iron"].cutoff - cut) < 1e-9 and rows["vein"].cutoff == 75.0 and rows["vein"].targets == 0
    assert abs(rows["iron"].high_km2 - 45 * 0.0004) < 1e-12 and rows["overall"].n == 2 and rows["iron"].n == 1 and rows["iron"].top10 == 1.0
    best = max(score[r, c] for r in (3, 4, 5) for c in (3, 4, 5))
    assert abs(rows["iron"].auc - sum(v <= best for v in ground) / len(ground)) < 1e-12
    targets = made.targets.collect()
    assert [t.id for t in targets] == list(range(1, len(targets) + 1)) and all(t.pixels >= 12 for t in targets)
    high = [(r, c) for (r, c), v in score.items() if v >= cut and r < 10]
    assert len(targets) == 1 and targets[0].model == "iron" and targets[0].pixels == len(high) and abs(targets[0].area_ha - 0.04 * len(high)) < 1e-9
    assert np.allclose([targets[0].x, targets[0].y, targets[0].elevation], [np.mean([c + 0.5 for _, c in high]), np.mean([r + 0.5 for r, _ in high]), np.mean([100.0 * r for r, _ in high])])
    assert prospecting.prospects(df, ["iron"], 50).models.filter("n is null").count() == 2


def test_region_analyses_end_in_targets(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(r, c, 5, 1000.0 + 12 * c + float(rng.normal(0, 1)), *(0.2 + 0.02 * rng.random(6) + (0.3 if 8 < r < 14 and 8 < c < 14 else 0)).tolist()) for r in range(32) for c in range(32)]
    spark.createDataFrame(rows, "r long, c long, scl int, dem double, blue double, green double, red double, nir double, swir1 double, swir2 double").write.parquet(str(tmp_path / "composite"))
    region = Region(spark, str(tmp_path), 500000.0, 3900000.0, 43, 32, tile=32)
    points = spark.createDataFrame([(1, 75.0022, 35.2385, "pegmatite")], "key long, lon double, lat double, model string")
    made = region.gem_analysis(points)
    assert {x.model for x in made.models.collect()} == {"overall", "marble", "pegmatite", "contact", "ultramafic"}
    assert made.models.filter("model = 'overall' and n = 1").count() == 1
    assert {"lon", "lat", "id", "model"} <= set(made.targets.columns)
    assert made.targets.filter("lon not between 74.99 and 75.02 or lat not between 35.2 and 35.3").count() == 0


@pytest.mark.parametrize("block", [4, 5])
def test_polygons_that_leave_their_blocks(spark, block):
    """Rings that wind over many blocks come out as in one block; chess boards meet by corners only."""
    rng = random.Random(block)
    snake = [[1 if r % 2 == 0 or c == (18 if r % 4 == 1 else 0) else 2 for c in range(19)] for r in range(17)]
    noise = [[rng.choice([1, 2, None] if c > 12 else [1, 2]) for c in range(19)] for _ in range(17)]
    chess = [[(r + c) % 2 for c in range(19)] for r in range(17)]
    for values in (snake, noise, chess):
        whole, parts = ({x.component: x for x in polygons.polygonise(grid(spark, values), "label", 19, None, size).collect()} for size in (32, block))
        assert whole == parts and set(parts) == set(flood(values))
        assert all(x.pixels == len(flood(values)[k]) == sum(map(signed, x.rings)) for k, x in parts.items())


@pytest.mark.parametrize(("corners", "cut"), [(True, None), (False, None), (False, 6)])
def test_components_over_tiles(spark, corners, cut):
    rng = random.Random(11)
    values = [[rng.choice([1, 1, 2]) for _ in range(23)] for _ in range(21)]
    cells = grid(spark, values)
    got, want = ({(x.r, x.c): x.component for x in targets.connected(cells, 23, "label", corners, cut, size).collect()} for size in (4, 64))
    assert got == want and len(got) == 21 * 23
    if not corners:
        assert {k: {p for p, v in got.items() if v == k} for k in set(got.values())} == flood(values, cut)
