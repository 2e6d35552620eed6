"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import importlib.util
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataframe.functions import geo
from strataframe.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Compared on larger tables, and by all that the driver compares, too: ties of rounding don't show on a thousand pixels.
LARGER = ["align_bilinear", "class_polygons", "composite_choice", "cube_areas", "overview_pyramid", "percentile_stretch", "pixel_patches", "presence_folds", "presence_ranks", "prospect_report", "scene_assets", "sensor_guess", "target_cutoffs", "warp_average"]


def connected_to(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected_to(DIR)


@pytest.fixture(scope="module")
def larger():
    return connected_to(DIR.replace("sf0.001", "sf0.01"))


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.4f}".replace("-0.0000", "0.0000")
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return str(v)


def compare(spark, con, folder, name, shown):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(x) for x in row) for row in df.select(*columns).collect())
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, DIR, name, plain)


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_sql_on_more_rows(spark, larger, name):
    compare(spark, larger, DIR.replace("sf0.001", "sf0.01"), name, lambda v: f"{v:.8g}" if isinstance(v, float) else repr(v))


def test_entry_has_rows(spark):
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_under_test", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() >= 7
    assert set(module.oracle_sql()) <= set(module.queries())


def test_utm_there_and_back(spark):
    at = spark.range(3000).select((F.col("id") % 60 * 6 - 180 + (F.col("id") % 600) / 100).alias("lon"), (F.col("id") * 7 % 1640 / 10 - 80).alias("lat"))
    zone = geo.utm_zone(F.col("lon"))
    for south in (False, True):
        half = at.filter("lat < 0" if south else "lat >= 0").withColumn("zone", zone)
        east, north = geo.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
        lon, lat = geo.from_utm(F.col("e"), F.col("n"), F.col("zone"), south)
        worst = half.withColumns({"e": east, "n": north}).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
        assert max(worst) < 1e-9
