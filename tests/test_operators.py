"""Operators without an SQL form, and edge cases, against plain Python."""

import json
import math
import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataframe.functions import hyperspectral as h
from strataframe.functions import scalars, spectral
from strataframe.operators import grids, jobs, neighbourhood, scenes, spatial, statistics, targets
from strataframe.sinks import tiles, vectors
from strataframe.sources.vectors import geojson_features, occurrences, out_of_range, polygons, unit_classes
from strataframe.streaming import field

GEMS = {"ruby": "marble", "topaz": "pegmatite"}


def grid(spark, rows, cols, value):
    return spark.createDataFrame([(r, c, value(r, c)) for r in range(rows) for c in range(cols)], "r long, c long, v double")


def reflect(i, n):
    return -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i


@pytest.mark.parametrize("size", [3, 5])
def test_box_mean_mirrors_edges(spark, size):
    rng = random.Random(1)
    v = {(r, c): rng.random() for r in range(7) for c in range(9)}
    out = neighbourhood.box(grid(spark, 7, 9, lambda r, c: v[r, c]), {"m": "v"}, size).collect()
    k = size // 2
    assert len(out) == 63
    for row in out:
        near = [v[reflect(row.r + a, 7), reflect(row.c + b, 9)] for a in range(-k, k + 1) for b in range(-k, k + 1)]
        assert abs(row.m - sum(near) / len(near)) < 1e-12


def test_majority_takes_lowest_class_on_ties_and_leaves_masks(spark):
    df = grid(spark, 9, 9, lambda r, c: 0.0).withColumn("k", F.expr("case when r = 4 and c = 4 then 5 when r = 0 and c = 0 then 250 else 2 end"))
    out = {(x.r, x.c): x.m for x in neighbourhood.majority(df, "k", 3, "m").collect()}
    assert out[4, 4] == 2 and out[0, 0] == 250 and set(out.values()) == {2, 250}


def test_components_against_flood_fill(spark):
    rng = random.Random(5)
    cells = {(r, c) for r in range(25) for c in range(30) if rng.random() < 0.42}
    got = {(x.r, x.c): x.component for x in targets.connected(spark.createDataFrame(sorted(cells), "r long, c long"), 30).collect()}
    seen = {}
    for start in sorted(cells):
        if start in seen:
            continue
        stack = [start]
        while stack:
            at = stack.pop()
            if at in seen or at not in cells:
                continue
            seen[at] = start[0] * 30 + start[1]
            stack += [(at[0] + a, at[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert got == seen
    assert targets.connected(spark.createDataFrame([], "r long, c long"), 30).count() == 0


def test_targets_apart_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], rng.uniform(0, 3000), rng.uniform(0, 3000), float(rng.randint(1, 9))) for i in range(120)]
    out = targets.apart(spark.createDataFrame(rows, "component long, model string, x double, y double, rank_score double"), "model", 500.0, 10)
    got = {m: {r.component for r in out.collect() if r.model == m} for m in "ab"}
    for m in "ab":
        kept = []
        for i, _, x, y, _ in sorted((r for r in rows if r[1] == m), key=lambda r: (-r[4], r[0])):
            if len(kept) < 10 and all(math.hypot(x - a, y - b) >= 500 for _, a, b in kept):
                kept.append((i, x, y))
        assert got[m] == {i for i, _, _ in kept}


def test_targets_apart_beyond_the_first_head(spark, monkeypatch):
    """Nearly all good targets lie in one place, so that the choice must go on below them."""
    monkeypatch.setattr(targets, "HEAD", 10)
    rng = random.Random(3)
    rows = [(i, "a", rng.uniform(0, 100), rng.uniform(0, 100), 100.0 + i) for i in range(60)] + [(100 + i, "a", rng.uniform(0, 5000), rng.uniform(0, 5000), float(i)) for i in range(60)]
    out = targets.apart(spark.createDataFrame(rows, "component long, model string, x double, y double, rank_score double"), "model", 500.0, 8)
    kept = []
    for i, _, x, y, _ in sorted(rows, key=lambda r: (-r[4], r[0])):
        if len(kept) < 8 and all(math.hypot(x - a, y - b) >= 500 for _, a, b in kept):
            kept.append((i, x, y))
    assert {r.component for r in out.collect()} == {i for i, _, _ in kept}


def test_accuracy_of_fifty_and_fifty_with_fifteen_swaps(spark):
    rows = [(1, 1)] * 35 + [(1, 2)] * 15 + [(2, 2)] * 35 + [(2, 1)] * 15 + [(9, 1)]
    row = statistics.accuracy(statistics.confusion(spark.createDataFrame(rows, "t int, p int"), "t", "p", [1, 2])).first()
    assert row.n == 100 and abs(row.overall - 0.7) < 1e-12 and abs(row.kappa - 0.4) < 1e-12
    none = statistics.accuracy(statistics.confusion(spark.createDataFrame([], "t int, p int"), "t", "p", [1, 2])).first()
    assert (none.n, none.overall, none.kappa) == (0, 0.0, 0.0)


def test_success_rates_of_two_high_scores(spark):
    scores = lambda x: spark.createDataFrame([(float(s),) for s in x], "score double")
    row = statistics.success_rates(scores([95, 99]), scores(range(100))).first()
    assert (row.n, round(row.auc, 3), row.top10, row.top20) == (2, 0.98, 1.0, 1.0)
    assert statistics.success_rates(scores([]), scores([])).first().n == 0


def test_land_cover_of_known_spectra(spark):
    rows = [(0, 0.2, 0.22, 0.25, 0.28, 0.33, 0.3), (250, 0.8, 0.8, 0.78, 0.7, 0.1, 0.08), (251, 0.08, 0.07, 0.05, 0.02, 0.01, 0.01), (252, 0.03, 0.06, 0.04, 0.4, 0.2, 0.1), (253, 0.01, 0.011, 0.012, 0.013, 0.014, 0.014)]
    df = spark.createDataFrame(rows, "want int, blue double, green double, red double, nir double, swir1 double, swir2 double")
    assert all(r.want == r.got for r in df.withColumn("got", spectral.landcover()).collect())
    codes = df.withColumn("scl", F.lit(6)).withColumn("got", spectral.landcover(F.col("scl"))).select("got").distinct().collect()
    assert [r.got for r in codes] == [251]


def test_masks_of_codes_and_bits(spark):
    df = spark.createDataFrame([(4, 21824), (9, 8), (3, 32), (11, 0), (None, None)], "scl int, qa int")
    rows = df.select(spectral.scl_masked(F.col("scl")).alias("s"), spectral.qa_masked(F.col("qa")).alias("q")).collect()
    assert [(r.s, r.q) for r in rows] == [(False, False), (True, True), (True, False), (False, False), (True, True)]


def test_quartz_index_needs_positive_emissivity(spark):
    df = spark.createDataFrame([(0.75, 0.86, 0.74), (0.0, 0.9, 0.9), (None, 1.0, 1.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(spectral.quartz_index(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert abs(got[0] - 0.86 * 0.86 / (0.75 * 0.74)) < 1e-12 and got[1:] == [None, None]


def test_interpolation_clamps(spark):
    knots = ((0.0, 0.0), (10.0, 0.1), (20.0, 0.4))
    df = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (15.0,), (99.0,), (None,)], "x double")
    got = [r[0] for r in df.select(scalars.interpolate(F.col("x"), knots)).collect()]
    assert got[-1] is None and [round(v, 9) for v in got[:-1]] == [0.0, 0.0, 0.05, 0.25, 0.4]


def test_minerals_of_made_spectra(spark):
    wl = [420.0 + 10 * k for k in range(204)]
    dip = lambda spots: [0.5 - sum(d * math.exp(-(((w - at) / 18) ** 2)) for at, d in spots) for w in wl]
    spectra = {"kaolinite": dip([(2205, 0.12), (2165, 0.1)]), "sericite": dip([(2200, 0.12), (2350, 0.08)]), "calcite": dip([(2340, 0.15)]), None: dip([])}
    df = spark.createDataFrame([(k, v) for k, v in spectra.items()], "name string, s array<double>")
    names = list(h.MAIN)
    for row in h.with_depths(df, "s", wl).withColumn("code", h.deepest(list(h.MAIN))).collect():
        assert (names[row.code - 1] if row.code else None) == row.name
    assert h.places([2000.0, 2100.0], (2120, 2205, 2245)) == []


def test_composite_prefers_clear_and_falls_back_on_snow(spark):
    rows = [(1, 4, 0.2), (1, 5, 0.4), (1, 11, 0.9), (2, 11, 0.8), (2, 9, 0.1), (3, 9, 0.5), (4, 6, 0.1), (4, 6, 0.1), (4, 4, 0.3)]
    got = {r.cell: (r.b, r.code) for r in scenes.composite(spark.createDataFrame(rows, "cell int, scl int, b double"), ["cell"], ["b"]).collect()}
    assert got == {1: (3000, 4), 2: (8000, 11), 3: (0, 0), 4: (1000, 6)}


def test_distances_are_exact_however_far(spark):
    rng = random.Random(8)
    marked = {(rng.randrange(30), rng.randrange(40)) for _ in range(9)}
    cells = grid(spark, 30, 40, lambda r, c: 0.0)
    flagged = cells.withColumns({"a": F.lit(False), "none": F.lit(False)})
    for r, c in marked:
        flagged = flagged.withColumn("a", F.col("a") | ((F.col("r") == r) & (F.col("c") == c)))
    for x in spatial.distances(flagged, {"d": "a", "e": "none"}, 10.0).collect():
        assert abs(x.d - 10 * min(math.hypot(x.r - r, x.c - c) for r, c in marked)) < 1e-9 and x.e is None


def test_a_box_reads_the_raster_once(spark, tmp_path):
    grid(spark, 8, 8, lambda r, c: float(r * c)).write.parquet(str(tmp_path / "g"))
    df = spark.read.parquet(str(tmp_path / "g"))
    name = next(c for c in df.columns if c not in ("r", "c"))
    plan = neighbourhood.box(neighbourhood.box(df, {"m": name}, 3), {"n": "m"}, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan


def test_tiles_halos_and_resampling(spark):
    box = spark.createDataFrame([(1, 3.0, 2.0, 25.0, 19.0)], "k int, west double, south double, east double, north double")
    tiles = grids.tile_grid(box, "k", 10.0).collect()
    assert sorted(t.tile for t in tiles) == ["000_000", "000_001", "001_000", "001_001", "002_000", "002_001"]
    assert min(t.left for t in tiles) == 0 and max(t.top for t in tiles) == 20
    df = grid(spark, 6, 6, lambda r, c: float(10 * r + c))
    name = next(c for c in df.columns if c not in ("r", "c"))
    halo = grids.with_halo(df, 3, 1)
    assert halo.filter("inner").count() == 36 and halo.filter("tr = 0 and tc = 0").count() == 16
    coarse = spark.createDataFrame([(0, 0), (1, 1), (9, 9)], "r long, c long")
    near = {(x.r, x.c): x[name] for x in grids.resampled(coarse, df, name, F.col("c") * 2 + 1.0, F.col("r") * 2 + 1.0, "bilinear").collect()}
    assert near == {(0, 0): 5.5, (1, 1): 27.5, (9, 9): None}
    one = {(x.r, x.c): x[name] for x in grids.resampled(coarse, df, name, F.col("c") * 2 + 0.5, F.col("r") * 2 + 0.5).collect()}
    assert one == {(0, 0): 0.0, (1, 1): 22.0, (9, 9): None}
    assert sorted((x.r, x.c) for x in grids.crop(df, 2, 3, 2, 2).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_pooled_samples_keep_to_their_caps(spark, monkeypatch):
    from strataframe.operators import sampling

    monkeypatch.setattr(sampling, "LEAST_CHECK", 4)
    monkeypatch.setattr(sampling, "LEAST_TEST", 4)
    rows = [(i, i % 6, ("train", "val", "test")[i % 3], 1) for i in range(600)]
    got = sampling.pooled(spark.createDataFrame(rows, "id long, area int, part string, label int"), "area", "part", "label", "id", 12, 6)
    assert {x.part: x.n for x in got.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train": 12, "val": 4, "test": 6}
    assert max(x.n for x in got.groupBy("area", "part").agg(F.count("*").alias("n")).collect()) <= 6


def test_lines_and_polygons_in_a_geopackage(spark, tmp_path):
    import sqlite3

    df = spark.createDataFrame([(1, [[0.0, 0.0], [3.0, 4.0]], [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]])], "k int, line array<array<double>>, rings array<array<array<double>>>")
    path = str(tmp_path / "y.gpkg")
    vectors.write_geopackage(path, {"lines": vectors.Layer(df.select("k", "line"), "LINESTRING", "line"), "areas": vectors.Layer(df.select("k", "rings"), "POLYGON", "rings")})
    with sqlite3.connect(path) as db:
        assert {r[0] for r in db.execute("SELECT srs_id FROM gpkg_spatial_ref_sys")} == {-1, 0, 4326}
        assert db.execute("SELECT min_x, min_y, max_x, max_y FROM gpkg_contents WHERE table_name = 'lines'").fetchone() == (0.0, 0.0, 3.0, 4.0)
        blob = db.execute("SELECT geom FROM lines").fetchone()[0]
        assert blob[:2] == b"GP" and blob[40:45] == b"\x01\x02\x00\x00\x00"
    line, polygon = df.select(vectors.line_feature(F.col("line"), ["k"]).alias("a"), vectors.polygon_feature(F.col("rings"), ["k"]).alias("b")).first()
    assert json.loads(line)["geometry"] == {"type": "LineString", "coordinates": [[0.0, 0.0], [3.0, 4.0]]}
    assert json.loads(polygon)["geometry"]["type"] == "Polygon"


def test_infinities_are_not_valid(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(0.1,), (inf,), (-inf,), (nan,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.is_finite(F.col("x"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(scalars.finite(F.col("x"))).collect()] == [0.1, scalars.LARGEST, -scalars.LARGEST, 0.0, 0.0]


def test_polygons_last_one_wins_and_holes_stay_open(spark, tmp_path):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = {"type": "FeatureCollection", "features": [
        {"geometry": {"type": "Polygon", "coordinates": [square(0, 6), square(2, 4)]}, "properties": {"unit": "1"}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [[square(4, 8)]]}, "properties": {"unit": "2"}},
        {"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}},
    ]}
    path = tmp_path / "shapes.geojson"
    path.write_text(json.dumps(shapes))
    found = polygons(geojson_features(spark, str(path))).withColumn("k", F.col("properties")["unit"].cast("int"))
    out = {(x.r, x.c): x.k for x in spatial.rasterize(grid(spark, 9, 9, lambda r, c: 0.0), found, "k").collect()}
    assert out[0, 0] == 1 and (3, 3) not in out and out[5, 5] == 2 and out[7, 7] == 2 and len(out) == 36 - 4 + 12


def test_occurrences_with_other_headers(spark):
    df = spark.createDataFrame([("35.5", "74.2", " Rubies ", "a"), ("", "74", "topaz", "b"), ("95", "10", "Topaz", "c"), ("36", "75", "opal", None)], "Latitude string, LNG string, Gem string, name string")
    got = occurrences(df, GEMS | {"rubie": "marble"}).collect()
    assert [(r.lat, r.lon, r.model) for r in got] == [(35.5, 74.2, "marble"), (95.0, 10.0, "pegmatite"), (36.0, 75.0, None)]
    assert out_of_range(occurrences(df, GEMS)).count() == 1


def test_unit_names_short_names_and_numbers(spark):
    df = spark.createDataFrame([("Kohat Limestone",), ("kl",), ("3",), ("9",), ("?",)], "u string")
    got = [r[0] for r in df.select(unit_classes(F.col("u"), {"Kohat Limestone": 1}, {"KL": 1})).collect()]
    assert got == [1, 1, 3, None, None]


def test_jobs(spark):
    rows = [(1, 10, "queued", 0.0, 0), (2, 10, "running", 100.0, 3), (3, 11, "queued", 0.0, 0), (4, None, "queued", 0.0, 0), (5, 12, "running", 900.0, 0)]
    df = spark.createDataFrame(rows, "id int, region int, status string, heartbeat double, attempts int")
    assert {r.id for r in jobs.claimable(df).collect()} == {3, 4}
    assert [(r.id, r.next_status) for r in jobs.stale(df, 1000.0).collect()] == [(2, "failed")]


def test_tiles_and_score_codes(spark, tmp_path):
    df = grid(spark, 10, 10, lambda r, c: float(r * 10 + c))
    tiles.write_tiles(df, str(tmp_path / "t"), 4)
    assert tiles.read_tiles(spark, str(tmp_path / "t"), ["000_001"]).count() == 16
    assert tiles.read_tiles(spark, str(tmp_path / "t")).count() == 100
    codes = spark.createDataFrame([(2.5,), (3.5,), (None,)], "s double").select(tiles.encoded_score(F.col("s")).alias("k")).collect()
    assert [r.k for r in codes] == [3, 5, 0]


def test_features_and_geopackage(spark, tmp_path):
    df = spark.createDataFrame([(74.1, 35.2, 1, "a"), (74.3, 35.4, 2, None)], "lon double, lat double, n int, name string")
    vectors.write_features(df, str(tmp_path / "f"))
    assert vectors.read_features(spark, str(tmp_path / "f"), "n: int, name: string").orderBy("n").collect() == df.orderBy("n").collect()
    path = str(tmp_path / "x.gpkg")
    vectors.write_points_geopackage(path, {"targets": df, "none": df.limit(0)})
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*) FROM targets").fetchone() == (2,)
        geometry = db.execute("SELECT geom FROM targets WHERE n = 1").fetchone()[0]
        assert geometry[:2] == b"GP" and geometry.endswith(vectors.point_wkb(74.1, 35.2))
        assert {r[0] for r in db.execute("SELECT table_name FROM gpkg_contents")} == {"targets", "none"}


def test_stream_drops_repeats(spark, tmp_path):
    rows = [(i % 5, f"2024-01-01 00:0{i % 5}:00", 35.0, 74.0, 1, 2) for i in range(20)]
    spark.createDataFrame(rows, "id int, t string, lat double, lon double, class_id int, certainty int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string, lat double, lon double, class_id int, certainty int").parquet(str(tmp_path / "in"))
    once = field.deduplicated(stream.withColumn("ts", F.to_timestamp("t")).filter(field.accepted()), "id")
    out = field.run_once(once, "observations_once", str(tmp_path / "ck"))
    assert Counter(r.id for r in out.collect()) == Counter(range(5))
