"""GeoTIFF, sieve and lineaments."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from strataframe.operators import lineaments, targets
from strataframe.sources import geotiff


def grid(spark, rows, cols, value):
    return spark.createDataFrame([(r, c, value(r, c)) for r in range(rows) for c in range(cols)], "r long, c long, v double")


def test_geotiff_round_trip(spark, tmp_path):
    geotiff.register(spark)
    df = grid(spark, 70, 50, lambda r, c: float(r * 50 + c)).withColumn("w", F.when(F.col("c") == 3, None).otherwise(-F.col("v")))
    paths = geotiff.write_geotiff(df, str(tmp_path / "t"), ["v", "w"], size=40)
    assert [p.rpartition("/")[2] for p in paths] == ["000_000.tif", "000_001.tif", "001_000.tif", "001_001.tif"]
    back = spark.read.format("geotiff").option("strips", 1).load(paths[0])
    assert back.columns == ["r", "c", "b1", "b2"] and back.count() == 1600
    got = {(x.r, x.c): (x.b1, x.b2) for x in back.collect()}
    assert got[5, 7] == (257.0, -257.0) and got[5, 3] == (253.0, None)
    assert geotiff.read_header(paths[3])[256] == 10


def test_geotiff_reads_whole_number_predictor(spark, tmp_path):
    geotiff.register(spark)
    values = np.random.default_rng(0).integers(0, 60000, (10, 12, 1)).astype("u2")
    path = tmp_path / "x.tif"
    path.write_bytes(geotiff.encode(values, 20.0, 0.0, 0.0, 32643, 0, rows=4))
    got = {(x.r, x.c): x.b1 for x in spark.read.format("geotiff").load(str(path)).collect()}
    assert all(got[r, c] == (float(values[r, c, 0]) or None) for r in range(10) for c in range(12))


def test_sieve_gives_small_patches_to_the_largest_neighbour(spark):
    value = lambda r, c: 3.0 if (r, c) in ((2, 2), (2, 3)) else 1.0 if c < 5 else 2.0 if c < 9 else 5.0
    out = {(x.r, x.c): x.out for x in targets.sieve(grid(spark, 6, 10, value).withColumn("k", F.col("v").cast("int")), "k", 10, 7, "out").collect()}
    assert out[2, 2] == 1 and out[0, 9] == 2 and out[0, 0] == 1 and out[0, 6] == 2


def test_components_of_one_label_by_sides(spark):
    rng = random.Random(3)
    v = {(r, c): rng.randint(0, 2) for r in range(12) for c in range(12)}
    cells = grid(spark, 12, 12, lambda r, c: float(v[r, c])).withColumn("k", F.col("v").cast("int"))
    got = {(x.r, x.c): x.component for x in targets.connected(cells, 12, "k", corners=False).collect()}
    seen = {}
    for start in sorted(v):
        if start in seen:
            continue
        stack = [start]
        while stack:
            at = stack.pop()
            if at in seen or v.get(at) != v[start]:
                continue
            seen[at] = start[0] * 12 + start[1]
            stack += [(at[0] + a, at[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    assert got == seen


def test_straight_lines_and_their_strike(spark):
    marked = grid(spark, 60, 60, lambda r, c: 0.0).withColumn("edge", F.col("c") == 30)
    found = lineaments.straightness(marked, 15)
    best = {(x.r, x.c): (x.straight, x.angle) for x in found.filter("edge").collect()}
    assert best[30, 30] == (1.0, 0) or abs(best[30, 30][0] - 1) < 1e-9 and best[30, 30][1] == 0
    lines = lineaments.segments(found, 60).collect()
    assert max(x.length_m for x in lines) >= 900 and all(x.length_m >= 400 for x in lines)
    rose = {x.sector: x.km for x in lineaments.rose(lineaments.segments(found, 60)).collect()}
    assert len(rose) == 12 and rose[0] == max(rose.values())


def test_fault_in_relief_is_an_edge(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 0.3, (40, 40))
    dem = lambda r, c: float(1000 + base[r, c] - 150 * math.exp(-((c - r) / 2.5) ** 2))
    df = grid(spark, 40, 40, dem).withColumnRenamed("v", "dem")
    out = lineaments.straightness(lineaments.edges(df), 11)
    near = out.filter("abs(c - r) <= 3 and straight >= 0.7").count()
    far = out.filter("abs(c - r) > 8 and straight >= 0.7").count()
    assert near > 40 and near > 3 * far
    assert lineaments.density(out.withColumn("line", F.col("straight") >= 0.7), "line", 3, 20.0, "d").agg(F.max("d")).first()[0] > 0
