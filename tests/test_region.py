"""The region workflow from observations to statistics."""

from pyspark.sql import functions as F

from strataframe.functions import geo
from strataframe.functions.classes import BANDS
from strataframe.plans.region import Region
from strataframe.sources.pixels import pixels

DIR = "/root/testdata/sf0.001"


def test_region_from_observations_to_statistics(spark, tmp_path):
    px = pixels(spark, DIR)
    seen = px.select("r", "c", "scl", *BANDS)
    again = px.select("r", "c", F.lit(4).alias("scl"), *BANDS)
    region = Region(spark, str(tmp_path / "region"), 500000.0, 3900000.0, 43, 100, tile=64)
    made = region.acquire(seen.unionByName(again), px.select("r", "c", "dem"))
    assert made.count() == px.count() and made.filter("scl = 0").count() == 0
    labels = px.select("r", "c", F.col("k").cast("int").alias("label"))
    classes = region.classify(region.train(labels, trees=10))
    assert classes.count() == px.count()
    stats = {r.class_id: r for r in region.statistics().collect()}
    assert sum(r.pixels for r in stats.values()) == px.count()
    assert abs(sum(stats[k].percent for k in range(1, 8)) - 100) < 1e-9
    assert region.analyze().filter("score between 0 and 100").count() == px.count()
    before = region.table("alteration").inputFiles()
    assert region.analyze().inputFiles() == before
    lon, lat = geo.from_utm(F.col("c") * 20 + 500010.0, F.lit(3899990.0) - F.col("r") * 20, F.lit(43))
    points = px.filter("id % 7 = 0").select(F.col("id").alias("key"), lon.alias("lon"), lat.alias("lat"), F.col("k").cast("int").alias("class_id"))
    row = region.validate(points).first()
    assert row.n > 50 and row.overall > 0.7
    gems = region.gems(labels)
    assert gems.count() == px.count() and gems.filter("marble between 0 and 100 and pegmatite between 0 and 100 and contact between 0 and 100 and ultramafic between 0 and 100").count() == px.count()
    minerals = region.minerals(px.filter("c = 50").select("r", "c"))
    assert minerals.count() == px.count() and minerals.filter("iron between 0 and 100 and copper between 0 and 100 and vein between 0 and 100").count() == px.count()
    found = region.alteration_targets(threshold=10.0, least=2)
    assert {"lon", "lat", "kind", "rank_score"} <= set(found.columns) and found.filter("lon is null or lat is null").count() == 0
