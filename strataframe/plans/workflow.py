"""Queries from the acquisition, mapping and reporting steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, hyperspectral
from ..functions.classes import BANDS, SCL_CLEAR
from ..functions.scalars import clip, lookup, mean_of
from ..operators import convnet, halos, learning, neighbourhood, spatial, statistics, svm, targets
from ..sinks import tiles
from ..sources.pixels import pixels, table
from .raster import SIX, rounded, surface
from .registry import PX, query


@query("dem_tile_names", """WITH b AS (SELECT s_suppkey AS k, s_suppkey % 20 - 10 + 0.3e0 AS west, s_suppkey % 20 - 8.5e0 AS east, s_suppkey % 7 - 3.2e0 AS south, s_suppkey % 7 - 2.1e0 AS north FROM supplier)
SELECT k, (CASE WHEN la >= 0 THEN 'N' ELSE 'S' END) || lpad(abs(la)::VARCHAR, 2, '0') || '_' || (CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END) || lpad(abs(lo)::VARCHAR, 3, '0') AS tile
FROM b, range(-20, 20) x(lo), range(-10, 10) y(la) WHERE lo >= floor(west) AND lo < ceil(east) AND la >= floor(south) AND la < ceil(north)""")
def dem_tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-degree elevation tiles that cover each box."""
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select(k.alias("k"), (k % 20 - 10 + F.lit(0.3)).alias("west"), (k % 20 - F.lit(8.5)).alias("east"), (k % 7 - F.lit(3.2)).alias("south"), (k % 7 - F.lit(2.1)).alias("north"))
    degrees = lambda low, high: F.explode(F.sequence(F.floor(low), F.ceil(high) - 1))
    spread = boxes.withColumn("lo", degrees("west", "east")).withColumn("la", degrees("south", "north"))
    name = F.concat(
        F.when(F.col("la") >= 0, "N").otherwise("S"), F.lpad(F.abs("la").cast("string"), 2, "0"), F.lit("_"),
        F.when(F.col("lo") >= 0, "E").otherwise("W"), F.lpad(F.abs("lo").cast("string"), 3, "0"),
    )
    return spread.select("k", name.alias("tile"))


@query("season_ranges", "SELECT y::INT AS year, m::INT AS month, make_date(y, m, 1) AS first_day, last_day(make_date(y, m, 1)) AS last_day FROM range(2022, 2025) a(y), range(7, 11) b(m)")
def season_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of each month of a season."""
    months = spark.range(2022, 2025).select(F.col("id").cast("int").alias("year")).withColumn("month", F.explode(F.sequence(F.lit(7), F.lit(10))))
    first = F.make_date("year", "month", F.lit(1))
    return months.select("year", "month", first.alias("first_day"), F.last_day(first).alias("last_day"))


_BOXES = """WITH scene AS (SELECT o_orderkey AS item, (o_custkey % 60) * 1e0 AS x, (o_orderkey % 50) * 1e0 AS y, o_totalprice % 100 AS cloud FROM orders),
tile AS (SELECT n_nationkey AS tile, (n_nationkey % 5) * 12e0 AS tx, (n_nationkey // 5) * 10e0 AS ty FROM nation)"""


@query("scenes_on_tiles", _BOXES + "SELECT tile, count(*)::BIGINT AS scenes, round(min(cloud), 4) AS best FROM tile JOIN scene ON x < tx + 12 AND x + 3 > tx AND y < ty + 10 AND y + 3 > ty WHERE cloud < 30 GROUP BY tile")
def scenes_on_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose box meets a tile's; each scene names the few tiles it can meet, so that the join has keys."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("x"), (F.col("o_orderkey") % 50).alias("y"), (F.col("o_totalprice") % 100).alias("cloud")).filter("cloud < 30")
    near = o.withColumn("i", F.explode(F.sequence(F.floor(F.col("x") / 12), F.floor((F.col("x") + 3) / 12)))).withColumn("j", F.explode(F.sequence(F.floor(F.col("y") / 10), F.floor((F.col("y") + 3) / 10))))
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile"), (F.col("n_nationkey") % 5).cast("long").alias("i"), F.floor(F.col("n_nationkey") / 5).alias("j"))
    met = near.join(F.broadcast(grid), ["i", "j"]).filter("x < i * 12 + 12 and x + 3 > i * 12 and y < j * 10 + 10 and y + 3 > j * 10")
    return met.groupBy("tile").agg(F.count(F.lit(1)).alias("scenes"), F.round(F.min("cloud"), 4).alias("best"))


@query("clear_fractions", PX + "SELECT k::INT AS class, round(avg((scl IN (2, 4, 5, 7, 6))::INT), 6) AS clear, round(avg((scl = 11)::INT), 6) AS snow, round(avg((lc <> 0)::INT), 6) AS masked FROM surface GROUP BY k")
def clear_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda flag: F.round(F.avg(flag.cast("int")), SIX)
    return surface(spark, sf_dir).groupBy(F.col("k").cast("int").alias("class")).agg(share(F.col("scl").isin(*SCL_CLEAR, 6)).alias("clear"), share(F.col("scl") == 11).alias("snow"), share(F.col("lc") != 0).alias("masked"))


@query("probability_argmax", PX + ", p AS (SELECT id, lc, usable, (id * 3) % 17 / 17e0 AS p1, (id * 5) % 17 / 17e0 AS p2, (id * 7) % 17 / 17e0 AS p3 FROM surface) SELECT id, (CASE WHEN lc <> 0 THEN lc WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END)::INT AS class, round(CASE WHEN lc <> 0 THEN 0e0 ELSE greatest(p1, p2, p3) END, 6) AS confidence FROM p")
def probability_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array(*[(F.col("id") * m) % 17 / 17.0 for m in (3, 5, 7)])
    rock = F.col("lc") == 0
    return surface(spark, sf_dir).select("id", F.when(rock, F.array_position(p, F.array_max(p))).otherwise(F.col("lc")).cast("int").alias("class"), *rounded(confidence=F.when(rock, F.array_max(p)).otherwise(0.0)))


@query("map_agreement", PX + "SELECT id, (CASE WHEN k NOT BETWEEN 1 AND 7 OR label > 7 THEN 0 WHEN label = k AND id % 3 <> 0 THEN 1 ELSE 2 END)::INT AS agreement FROM surface")
def map_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("k").between(1, 7) & (F.col("label") <= 7)
    same = (F.col("label") == F.col("k")) & (F.col("id") % 3 != 0)
    return surface(spark, sf_dir).select("id", F.when(~both, 0).when(same, 1).otherwise(2).alias("agreement"))


@query("score_codes", PX + "SELECT id, (CASE WHEN usable THEN round_even((id * 37) % 201 / 2e0, 0)::INT + 1 ELSE 0 END)::INT AS code FROM surface")
def score_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("usable"), (F.col("id") * 37) % 201 / 2.0)
    return surface(spark, sf_dir).select("id", tiles.encoded_score(score).alias("code"))


@query("display_stretch", PX + "SELECT id, floor(pow(least(greatest(swir2 / 0.45e0, 0e0), 1e0), 1 / 1.4e0) * 255)::INT AS red, floor(pow(least(greatest(nir / 0.32e0, 0e0), 1e0), 1 / 1.4e0) * 255)::INT AS green FROM px")
def display_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    shade = lambda band, high: F.floor(F.pow(clip(F.col(band) / high, 0.0, 1.0), F.lit(1 / 1.4)) * 255).cast("int")
    return pixels(spark, sf_dir).select("id", shade("swir2", 0.45).alias("red"), shade("nir", 0.32).alias("green"))


_STEEP = PX + """, g AS (SELECT id, coalesce((lead(dem) OVER x - lag(dem) OVER x) / 40, (lead(dem) OVER x - dem) / 20, (dem - lag(dem) OVER x) / 20) AS gx,
    coalesce((lead(dem) OVER y - lag(dem) OVER y) / 40, (lead(dem) OVER y - dem) / 20, (dem - lag(dem) OVER y) / 20) AS gy FROM px WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r))"""


@query("bedrock_mask", _STEEP + "SELECT id, degrees(atan(sqrt(gx * gx + gy * gy))) >= 15e0 AS bedrock FROM g")
def bedrock_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.with_slope_and_aspect(pixels(spark, sf_dir)).select("id", (F.degrees("slope") >= 15.0).alias("bedrock"))


@query("gem_usable", PX + """SELECT t.id, any_value(t.usable) AND any_value((t.nir - t.red) / (t.nir + t.red + 1e-6)) <= 0.3e0 AND any_value((t.blue + t.green + t.red + t.nir + t.swir1 + t.swir2) / 6) >= 0.06e0 AND count(s.id) = 0 AS gem_usable
    FROM surface t LEFT JOIN surface s ON (s.lc = 250 OR s.scl = 9) AND abs(s.r - t.r) + abs(s.c - t.c) <= 5 GROUP BY t.id""")
def gem_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rock away from snow and gaps, hardly green, not dark."""
    df = surface(spark, sf_dir).withColumn("near", (F.col("lc") == 250) | (F.col("scl") == 9))
    df = neighbourhood.dilate(df, "near", 5, "off")
    ndvi = (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red") + 1e-6)
    return df.select("id", (F.col("usable") & ~F.col("off") & (ndvi <= 0.3) & (mean_of(BANDS) >= 0.06)).alias("gem_usable"))


@query("cluster_summary", PX + "SELECT (id % 5)::INT AS unit, count(*)::BIGINT AS n, " + ", ".join(f"round(avg({b}), 6) AS {b}" for b in BANDS) + ", round(avg(dem), 4) AS elevation FROM surface WHERE usable GROUP BY 1")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.round(F.avg(b), SIX).alias(b) for b in BANDS]
    return surface(spark, sf_dir).filter("usable").groupBy((F.col("id") % 5).cast("int").alias("unit")).agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.avg("dem"), 4).alias("elevation"))


@query("cluster_relabel", PX + "SELECT id, (CASE WHEN lc <> 0 THEN lc ELSE CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 0 END END)::INT AS class FROM surface")
def cluster_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lookup(F.col("id") % 5, {0: 1, 1: 4, 2: 5, 3: 2}, 0)
    return surface(spark, sf_dir).select("id", F.when(F.col("lc") != 0, F.col("lc")).otherwise(named).cast("int").alias("class"))


_TARGETS = "WITH t AS (SELECT l_orderkey * 1000000 + l_partkey AS component, l_returnflag AS model, (l_partkey * 37) % 20000 * 1e0 AS x, (l_suppkey * 911) % 20000 * 1e0 AS y, l_quantity * log10(10 + l_linenumber) AS rank_score FROM lineitem), u AS (SELECT component, model, any_value(x) AS x, any_value(y) AS y, max(rank_score) AS rank_score FROM t GROUP BY ALL)"


def _target_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("component"), F.col("l_returnflag").alias("model"), ((F.col("l_partkey") * 37) % 20000).cast("double").alias("x"),
        ((F.col("l_suppkey") * 911) % 20000).cast("double").alias("y"), (F.col("l_quantity") * F.log10(F.col("l_linenumber") + 10)).alias("rank_score"),
    )
    return items.groupBy("component", "model").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("rank_score").alias("rank_score"))


@query("top_targets_per_model", _TARGETS.replace("any_value(x)", "max(x)").replace("any_value(y)", "max(y)") + "SELECT component, model, round(rank_score, 6) AS rank_score, row_number() OVER (PARTITION BY model ORDER BY rank_score DESC, component)::INT AS place FROM u QUALIFY place <= 30")
def top_targets_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.top_per_group(_target_table(spark, sf_dir), "model", 30).select("component", "model", F.round("rank_score", SIX).alias("rank_score"), "place")


@query("targets_apart")
def targets_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice of targets 500 m apart, 50 per model; tests hold it against a plain loop."""
    return targets.apart(_target_table(spark, sf_dir), "model", 500.0, 50)


@query("high_score_area", PX + "SELECT k::INT AS model, round(count(*) FILTER ((id * 37) % 101 >= 75) * 0.0004e0, 6) AS km2 FROM px GROUP BY k")
def high_score_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy(F.col("k").cast("int").alias("model")).agg(F.round(F.count_if((F.col("id") * 37) % 101 >= 75) * 0.0004, SIX).alias("km2"))


@query("latest_model", "WITH m AS (SELECT p_brand || '_v' || p_size AS name, p_brand AS family, p_size AS v FROM part) SELECT family, max(v)::INT AS version, family || '_v' || max(v) AS name FROM m GROUP BY family")
def latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest version of each model, versions being numbers at the end of names."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.concat("p_brand", F.lit("_v"), F.col("p_size").cast("string")).alias("name"))
    version = F.regexp_extract("name", "_v(\\d+)$", 1).cast("int")
    return names.withColumn("version", version).groupBy("family").agg(F.max("version").alias("version"), F.max_by("name", "version").alias("name"))


@query("tile_status_counts", "SELECT o_orderpriority AS region, count(*)::BIGINT AS tiles, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open FROM orders GROUP BY 1")
def tile_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("region")).agg(F.count(F.lit(1)).alias("tiles"), F.count_if(status == "F").alias("done"), F.count_if(status == "O").alias("open"))


@query("polygon_areas", "SELECT n_nationkey AS k, round(((8e0 + n_nationkey % 5) * (8 + n_nationkey % 5) - (8e0 + n_nationkey % 5) * (8 + n_nationkey % 5) / 8) - 4, 6) AS area FROM nation")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lit(8.0) + F.col("n_nationkey") % 5
    ring = lambda *xy: F.array(*[F.array(a, b) for a, b in xy])
    z, two, four = F.lit(0.0), F.lit(2.0), F.lit(4.0)
    rings = F.array(ring((z, z), (s, z), (s, s / 2), (s / 2, s), (z, s), (z, z)), ring((two, two), (four, two), (four, four), (two, four), (two, two)))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.round(spatial.polygon_area(rings), SIX).alias("area"))


@query("observation_regions", """WITH o AS (SELECT s_suppkey AS id, s_suppkey % 360 - 180 + 0.5e0 AS lon, s_suppkey % 180 - 90 + 0.5e0 AS lat FROM supplier), g AS (SELECT r_regionkey AS region_id, r_regionkey * 50 - 180 AS west, r_regionkey * 50 - 110 AS east FROM region)
SELECT id, min(region_id)::INT AS region_id FROM o LEFT JOIN g ON lon BETWEEN west AND east GROUP BY id""")
def observation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.field import located

    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 360 - 180 + F.lit(0.5)).alias("lon"), (F.col("s_suppkey") % 180 - 90 + F.lit(0.5)).alias("lat"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), (F.col("r_regionkey") * 50 - 180).alias("west"), (F.col("r_regionkey") * 50 - 110).alias("east"), F.lit(-90).alias("south"), F.lit(90).alias("north"))
    return located(found, regions).select("id", "region_id")


@query("observation_squares", "SELECT s_suppkey AS id, round(s_suppkey * 10 - 20e0, 3) AS x0, round(s_suppkey * 10 + 20e0, 3) AS x1, (s_suppkey % 7 + 1)::INT AS class FROM supplier WHERE s_suppkey % 3 + 1 >= 2")
def observation_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training squares of 40 m around observations that are certain enough."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(k % 3 + 1 >= 2).select(k.alias("id"), F.round(k * 10 - F.lit(20.0), 3).alias("x0"), F.round(k * 10 + F.lit(20.0), 3).alias("x1"), (k % 7 + 1).cast("int").alias("class"))


_HEADERS = """WITH h AS (SELECT n_nationkey AS k, list_transform(range(0, 5 + n_nationkey % 12), lambda i: round(CASE WHEN n_nationkey % 2 = 0 THEN 400 + 10 * i ELSE 0.4 + 0.01 * i END, 3)::DOUBLE) AS w FROM nation)"""


@query("wavelength_numbers", _HEADERS + """SELECT k, CASE WHEN len(w) >= 10 THEN len(w) END::INT AS bands, CASE WHEN len(w) >= 10 THEN round(CASE WHEN list_max(w) < 30 THEN 1000 ELSE 1 END * w[1], 6) END AS first_nm,
    CASE WHEN len(w) >= 10 THEN round(CASE WHEN list_max(w) < 30 THEN 1000 ELSE 1 END * list_max(w), 6) END AS last_nm FROM h""")
def wavelength_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelengths from sidecar headers, half of them in micrometres; fewer than ten numbers are none."""
    k = F.col("n_nationkey")
    steps = F.sequence(F.lit(0), (k % 12 + 4).cast("int"))
    values = F.transform(steps, lambda i: F.when(k % 2 == 0, F.format_string("%.1f", (400 + 10 * i).cast("double"))).otherwise(F.format_string("%.3f", F.lit(0.4) + F.lit(0.01) * i)))
    header = F.concat(F.lit("ENVI\nbands = 3\nWavelength = {\n "), F.array_join(values, " ,\n "), F.lit("}\nfwhm = {1, 2}"))
    nm = table(spark, sf_dir, "nation").select(k.alias("k"), hyperspectral.header_wavelengths(header).alias("w"))
    return nm.select("k", F.when(F.col("w").isNotNull(), F.size("w")).alias("bands"), F.round(F.get("w", F.lit(0)), 6).alias("first_nm"), F.round(F.array_max("w"), 6).alias("last_nm"))


@query("mgrs_squares", """WITH p AS (SELECT s_suppkey AS k, (s_suppkey % 60 + 1)::INT AS zone, 200000e0 + (s_suppkey * 7919) % 600000 AS easting, (s_suppkey * 104729) % 9300000 * 1e0 AS northing, (s_suppkey % 84) * 1e0 AS lat FROM supplier)
SELECT k, zone, 32600 + zone AS epsg, lpad(zone::VARCHAR, 2, '0') || substr('CDEFGHJKLMNPQRSTUVWXX', floor((lat + 80) / 8)::INT + 1, 1) || substr((['ABCDEFGH', 'JKLMNPQR', 'STUVWXYZ'])[(zone - 1) % 3 + 1], floor(easting / 100000)::INT, 1)
    || substr('ABCDEFGHJKLMNPQRSTUV', (floor(northing / 100000)::INT + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1, 1) AS square FROM p""")
def mgrs_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon = k % 60 * 6 - 180 + F.lit(3.0)
    at = table(spark, sf_dir, "supplier").select(k.alias("k"), geo.utm_zone(lon).alias("zone"), geo.utm_epsg(lon, F.lit(40.0)).cast("int").alias("epsg"), (F.lit(200000.0) + (k * 7919) % 600000).alias("e"), ((k * 104729) % 9300000).cast("double").alias("n"), (k % 84).cast("double").alias("lat"))
    return at.select("k", "zone", "epsg", geo.mgrs_square(F.col("zone"), F.col("e"), F.col("n"), F.col("lat")).alias("square"))


@query("pixel_patches", PX + """, pat AS (SELECT r, c, id, nir FROM px),
rows_ AS (SELECT t.r, t.c, dr, s.nir FROM pat t, hw, range(-4, 5) a(dr), pat s WHERE s.c = t.c AND s.r = CASE WHEN t.r + dr < 0 THEN -(t.r + dr) WHEN t.r + dr >= h THEN 2 * h - 2 - (t.r + dr) ELSE t.r + dr END),
sums AS (SELECT r, c, sum(nir) AS s0, sum(nir * (dr + 4)) AS s1 FROM rows_ GROUP BY r, c)
SELECT t.id, round(sum(s.s1) * 9 + sum(s.s0 * (1 + dc + 4)), 6) AS fingerprint FROM pat t, hw, range(-4, 5) b(dc), sums s
    WHERE s.r = t.r AND s.c = CASE WHEN t.c + dc < 0 THEN -(t.c + dc) WHEN t.c + dc >= w THEN 2 * w - 2 - (t.c + dc) ELSE t.c + dc END GROUP BY t.id""")
def pixel_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted sum over the 9 x 9 patch of every pixel; beyond the edge patches are mirrored, the edge itself not repeated."""
    px = pixels(spark, sf_dir)
    weights = {(dr, dc): 1.0 + (dr + 4) * 9 + dc + 4 for dr in range(-4, 5) for dc in range(-4, 5)}
    sums = halos.patch_sums(px, "nir", weights, "fingerprint")
    return sums.join(px.select("r", "c", "id"), ["r", "c"]).select("id", F.round("fingerprint", SIX).alias("fingerprint"))


_LEARN = ["blue", "green", "red", "nir", "swir1", "swir2"]


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.sampling import block_split

    labelled = block_split(surface(spark, sf_dir).filter("usable"), 16).withColumn("y", (F.col("k") - 1).cast("double"))
    return labelled.filter("split = 0"), labelled.filter("split = 2")


@query("forest_accuracy")
def forest_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a random forest on blocks it hasn't seen."""
    train, test = _split(spark, sf_dir)
    scored = learning.forest(train, _LEARN, "y", trees=20).transform(test).withColumn("p", F.col("prediction").cast("int"))
    return statistics.accuracy(statistics.confusion(scored, "y", "p", list(range(7))))


@query("kernel_machine_accuracy")
def kernel_machine_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on unseen blocks of one radial machine for each two rocks."""
    train, test = _split(spark, sf_dir)
    scored = svm.fit(train, _LEARN, "k", "id").predict(test)
    return statistics.accuracy(statistics.confusion(scored, "k", "class", list(range(1, 8))))


@query("perceptron_accuracy")
def perceptron_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    scored = learning.perceptron(train, _LEARN, "y", 7).transform(test).withColumn("p", F.col("prediction").cast("int"))
    return statistics.accuracy(statistics.confusion(scored, "y", "p", list(range(7))))


@query("convolution_accuracy")
def convolution_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on unseen blocks of a network that looks at 9 x 9 cells; tests hold its gradients against differences."""
    from ..operators.sampling import block_split

    labelled = block_split(surface(spark, sf_dir), 16).withColumn("y", F.when(F.col("usable"), F.col("k")))
    net = convnet.fit(labelled.withColumn("y", F.when(F.col("split") == 0, F.col("y"))), _LEARN, "y", rounds=30, rate=6e-3)
    scored = net.predict(labelled).join(labelled.filter("split = 2 and y is not null").select("r", "c", "y"), ["r", "c"])
    return statistics.accuracy(statistics.confusion(scored, "y", "class", list(range(1, 8))))


@query("spectral_units")
def spectral_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means units of usable pixels, with how sure each is."""
    df = surface(spark, sf_dir).filter("usable")
    return learning.with_unit_confidence(learning.units(df, _LEARN, k=7), df).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))

