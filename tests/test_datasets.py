"""Areas and files: discovery, kinds of numbers, masks, problems."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataframe.functions.classes import BANDS
from strataframe.operators import datasets


def test_areas_of_a_folder(spark, tmp_path):
    root = tmp_path / "data"
    for name in ("a/image.tif", "a/labels.geojson", "a/labels.tiff", "a/dem.tif", "b/image.tiff", "b/image.tif", "b/labels.json", "b/area.json", "b/SAMPLE_DATA.txt", "c/dem.tif", "d/e/image.tif", "notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    found = {x.area: x for x in datasets.areas_of(datasets.files_under(spark, str(root)), str(root)).collect()}
    short = lambda x: x and x.rpartition("/")[2]
    assert sorted(found) == ["a", "b"]
    a, b = found["a"], found["b"]
    assert (short(a.labels), a.labels_kind, short(a.dem), a.settings, a.is_sample) == ("labels.tiff", "raster", "dem.tif", None, False)
    assert (short(b.image), short(b.labels), b.labels_kind, short(b.settings), b.is_sample) == ("image.tif", "labels.json", "vector", "area.json", True)
    (root / "image.tiff").write_bytes(b"x")
    alone = datasets.areas_of(datasets.files_under(spark, str(root)), f"{root}/").collect()
    assert [x.area for x in alone] == ["data"] and alone[0].labels is None and alone[0].labels_kind is None


def test_quantiles_against_a_limit_without_sorting(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randint(0, 6)) / 2) for k in range(300) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame([*rows, (0, None), (999, None)], "k int, v double")
    for q, limit in ((0.5, 2.0), (0.99, 1.5), (0.3, 1.1), (0.0, 0.5), (1.0, 2.5)):
        got = {x.k: x.at for x in df.groupBy("k").agg(datasets.at_most("v", q, limit).alias("at")).collect()}
        for k in range(300):
            assert got[k] == bool(np.percentile([v for j, v in rows if j == k], q * 100) <= limit)
        assert got[999] is None


def test_valid_pixels_by_the_rule_of_the_layer(spark):
    rows = [(k, *[0.3] * 6, v) for k, v in enumerate((4.0, 9.0, 0.0, None, float("nan"), 32.0))] + [(6, *[0.0] * 6, 4.0), (7, float("nan"), *[0.3] * 5, 4.0)]
    df = spark.createDataFrame(rows, ["id", *BANDS, "code"])
    valid = lambda rule: {x.id for x in datasets.masked(df, "code", F.lit(rule)).filter("valid").collect()}
    assert valid("scl") == {0, 5} and valid("qa") == {2, 5} and valid("binary") == {2, 3, 4}
    assert datasets.masked(df, None).filter("valid").count() == 0  # as bright in blue as in all else: haze
    assert {x.id for x in datasets.masked(df, None, threshold=None).filter("valid").collect()} == {0, 1, 2, 3, 4, 5}
    top = spark.createDataFrame([(11, "sentinel2"), (12, "sentinel2"), (200, "landsat89"), (3, "landsat89"), (1, "composite")], "top int, sensor string")
    assert [x[0] for x in top.select(datasets.mask_rule(F.col("top"), F.col("sensor"))).collect()] == ["scl", "binary", "qa", "qa", "binary"]


def test_problems_of_areas(spark):
    areas = spark.createDataFrame([("good", 6, True, True), ("bad", 5, False, False), ("bare", 7, True, True)], "area string, bands int, has_crs boolean, overlaps boolean")
    labels = spark.createDataFrame([("good", 1), ("good", 251), ("bad", 9), ("bad", 9), ("other", 44), ("bare", None)], "area string, v int")
    got = sorted(tuple(x) for x in datasets.problems(areas, labels).collect())
    assert got == [("bad", "few bands"), ("bad", "no coordinate system"), ("bad", "no overlap"), ("bad", "unknown class 9"), ("bare", "no labels")]


def test_colours_of_unknown_classes_are_null(spark):
    df = spark.createDataFrame([(1,), (255,), (9,), (None,)], "label int")
    got = [tuple(x)[1:] for x in datasets.colours(df, "label", {1: "#0a1b2c", 255: "#ffffff"}).collect()]
    assert got == [(10, 27, 44, 255), (255, 255, 255, 0), (None,) * 4, (None,) * 4]
