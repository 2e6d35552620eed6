"""Queries over scenes, observations, occurrences, documents' tables and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, hyperspectral
from ..functions.classes import COMMODITY_MODELS, MASKS, ROCKS
from ..operators import jobs, lineaments, sampling, scenes, spatial, statistics
from ..sources import vectors
from ..sources.pixels import pixels, table
from ..streaming import field
from .raster import surface
from .registry import PX, query


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of 97 cells on many days, with a scene code and two bands."""
    events = table(spark, sf_dir, "events")
    scl = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "view", 6).when(F.col("event_type") == "click", 6).when(F.col("event_type") == "signup", 11).otherwise(9)
    return events.select((F.col("user_id") % 97).alias("cell"), "event_id", scl.alias("scl"), (F.col("value") / 1000).alias("nir"), ((F.col("event_id") % 331) / 1000.0).alias("red"))


_OBS = """WITH obs AS (SELECT user_id % 97 AS cell, event_id, CASE event_type WHEN 'purchase' THEN 4 WHEN 'view' THEN 6 WHEN 'click' THEN 6 WHEN 'signup' THEN 11 ELSE 9 END AS scl,
    value / 1000 AS nir, (event_id % 331) / 1000e0 AS red FROM events)"""


def _band_sql(b: str) -> str:
    value = f"coalesce(median({b}) FILTER (scl IN (2, 4, 5, 7, 6)), median({b}) FILTER (scl = 11))"
    return f"CASE WHEN {value} IS NULL THEN 0 ELSE floor(least(greatest({value} * 10000, 1e0), 65535e0))::INT END AS {b}"


@query("temporal_median_composite", _OBS + f"""SELECT cell, {_band_sql("nir")}, {_band_sql("red")},
    (CASE WHEN count(*) FILTER (scl IN (4, 6)) > 0 THEN CASE WHEN 2 * count(*) FILTER (scl = 6) > count(*) FILTER (scl IN (4, 6, 11)) THEN 6 ELSE 4 END WHEN count(*) FILTER (scl = 11) > 0 THEN 11 ELSE 0 END)::INT AS code,
    count(*) FILTER (scl IN (4, 6))::BIGINT AS n_clear, count(*) FILTER (scl = 11)::BIGINT AS n_snow, count(*) FILTER (scl = 6)::BIGINT AS n_water FROM obs GROUP BY cell""")
def temporal_median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.composite(observations(spark, sf_dir), ["cell"], ["nir", "red"])


def scene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 40).alias("granule"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") % 100).alias("cloud")
    )


_SCENES = "WITH scenes AS (SELECT o_orderkey AS item, o_custkey % 40 AS granule, o_orderdate::DATE AS day, o_totalprice % 100 AS cloud FROM orders)"


@query("scene_dedup", _SCENES + "SELECT item, granule, day, cloud FROM scenes QUALIFY row_number() OVER (PARTITION BY granule, day ORDER BY cloud, item) = 1")
def scene_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.best_per_day(scene_table(spark, sf_dir))


@query("scene_round_robin", _SCENES + "SELECT item, granule, row_number() OVER (PARTITION BY granule ORDER BY floor(cloud / 5), day DESC, item)::INT AS turn FROM scenes WHERE cloud < 30")
def scene_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.round_robin(scene_table(spark, sf_dir).filter("cloud < 30")).select("item", "granule", "turn")


@query("mosaic_first_valid", "SELECT l_orderkey AS cell, arg_min(l_tax, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey)) FILTER (l_tax > 0.01) AS v FROM lineitem GROUP BY 1 HAVING v IS NOT NULL")
def mosaic_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("v"))
    return scenes.first_valid(reads, ["cell"], "ord", "v")


_DISTRICTS = """, shapes AS (SELECT n_nationkey AS ord, n_name AS district, (n_nationkey * 17) % 90 * 1e0 AS x, (n_nationkey * 29) % 90 * 1e0 AS y, 8e0 + n_nationkey % 5 AS s FROM nation)"""


def district_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons with a cut corner and a hole, in pixel coordinates: (ord, district, class, rings)."""
    k = F.col("n_nationkey")
    sized = table(spark, sf_dir, "nation").select(
        k.alias("ord"), F.col("n_name").alias("district"), (F.col("n_regionkey") + 1).alias("class"), ((k * 17) % 90).cast("double").alias("x"), ((k * 29) % 90).cast("double").alias("y"), (F.lit(8.0) + k % 5).alias("s")
    )
    ring = lambda *xy: F.array(*[F.array(F.col("x") + a, F.col("y") + b) for a, b in xy])
    s, h, two, four, zero = F.col("s"), F.col("s") / 2, F.lit(2.0), F.lit(4.0), F.lit(0.0)
    outer = ring((zero, zero), (s, zero), (s, h), (h, s), (zero, s), (zero, zero))
    hole = ring((two, two), (four, two), (four, four), (two, four), (two, two))
    return sized.select("ord", "district", "class", F.array(outer, hole).alias("rings"))


@query("zonal_class_area", PX + _DISTRICTS + """, placed AS (SELECT r, c, arg_max(district, ord) AS district FROM px JOIN shapes ON c + 0.5e0 > x AND c + 0.5e0 < x + s AND r + 0.5e0 > y AND r + 0.5e0 < y + s AND (c + 0.5e0 - x) + (r + 0.5e0 - y) < 1.5e0 * s
    AND NOT (c + 0.5e0 > x + 2 AND c + 0.5e0 < x + 4 AND r + 0.5e0 > y + 2 AND r + 0.5e0 < y + 4) GROUP BY r, c)
SELECT district, label::INT AS label, count(*)::BIGINT AS pixels, round(count(*) * 0.0004e0, 6) AS km2 FROM surface JOIN placed USING (r, c) GROUP BY ALL""")
def zonal_class_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the pixels in each district; where districts overlap the later one counts."""
    df = surface(spark, sf_dir)
    placed = spatial.rasterize(df, district_shapes(spark, sf_dir), "district")
    counts = statistics.zonal_histogram(df.join(placed, ["r", "c"]).withColumn("label", F.col("label").cast("int")), "district", "label")
    return counts.withColumn("km2", F.round(F.col("pixels") * 0.0004, 6))


_POINTS = ", pts AS (SELECT s_suppkey AS k, (s_suppkey * 7) % (SELECT h FROM hw) AS r, (s_suppkey * 13) % 100 AS c FROM supplier)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).agg((F.max("r") + 1).alias("h"))
    rows = statistics.with_row(table(spark, sf_dir, "supplier"), px)
    return rows.select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 7) % F.col("h")).alias("r"), ((F.col("s_suppkey") * 13) % 100).alias("c"))


@query("point_query", PX + _POINTS + "SELECT pts.k, label::INT AS label, round(dem, 6) AS dem, round(nir, 6) AS nir FROM pts LEFT JOIN surface s ON s.r = pts.r AND s.c = pts.c")
def point_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _points(spark, sf_dir).join(surface(spark, sf_dir).withColumnRenamed("k", "rock"), ["r", "c"], "left")
    return met.select("k", F.col("label").cast("int").alias("label"), F.round("dem", 6).alias("dem"), F.round("nir", 6).alias("nir"))


@query("field_validation", PX + _POINTS + ", v AS (SELECT pts.k % 7 + 1 AS t, label AS p FROM pts JOIN surface s ON s.r = pts.r AND s.c = pts.c WHERE label <= 7) SELECT count(*)::BIGINT AS n, round(avg((t = p)::INT), 6) AS overall FROM v")
def field_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _points(spark, sf_dir).join(surface(spark, sf_dir).withColumnRenamed("k", "rock"), ["r", "c"])
    matrix = statistics.confusion(met.withColumn("truth", F.col("k") % 7 + 1), "truth", "label", list(range(1, 8)))
    return statistics.accuracy(matrix).select("n", F.round("overall", 6).alias("overall"))


@query("occurrence_window_max", PX + _POINTS + "SELECT pts.k, round(max(s.nir), 6) AS nir FROM pts LEFT JOIN px s ON abs(s.r - pts.r) <= 1 AND abs(s.c - pts.c) <= 1 GROUP BY pts.k")
def occurrence_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.window_max(_points(spark, sf_dir), pixels(spark, sf_dir), "nir", "k").select("k", F.round("nir", 6).alias("nir"))


@query("pip_rasterize_labels", PX + """, shapes AS (SELECT n_nationkey AS ord, n_regionkey + 1 AS class, (n_nationkey * 17) % 90 * 1e0 AS x, (n_nationkey * 29) % 90 * 1e0 AS y, 8e0 + n_nationkey % 5 AS s FROM nation)
SELECT r, c, arg_max(class, ord)::INT AS class FROM px JOIN shapes ON c + 0.5e0 > x AND c + 0.5e0 < x + s AND r + 0.5e0 > y AND r + 0.5e0 < y + s AND (c + 0.5e0 - x) + (r + 0.5e0 - y) < 1.5e0 * s
    AND NOT (c + 0.5e0 > x + 2 AND c + 0.5e0 < x + 4 AND r + 0.5e0 > y + 2 AND r + 0.5e0 < y + 4) GROUP BY r, c""")
def pip_rasterize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.rasterize(pixels(spark, sf_dir), district_shapes(spark, sf_dir), "class").select("r", "c", F.col("class").cast("int").alias("class"))


@query("block_split_counts", PX + """, b AS (SELECT DISTINCT r // 32 AS yb, c // 32 AS xb FROM px), h AS (SELECT *, (((yb % 2147483648 * 1103515245 + 12345) % 2147483648 * 31 + xb) % 2147483648 * 1103515245 + 12345) % 2147483648 AS h FROM b),
o AS (SELECT *, row_number() OVER (ORDER BY h, yb, xb) AS rank, count(*) OVER () AS n FROM h),
s AS (SELECT yb, xb, CASE WHEN rank <= round_even(n * 0.6e0, 0) THEN 0 WHEN rank <= round_even(n * 0.6e0, 0) + round_even(n * 0.15e0, 0) THEN 1 ELSE 2 END AS split FROM o)
SELECT split::INT AS split, k::INT AS class, count(*)::BIGINT AS n FROM px JOIN s ON s.yb = r // 32 AND s.xb = c // 32 GROUP BY ALL""")
def block_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.block_split(pixels(spark, sf_dir)).groupBy("split", F.col("k").cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("stratified_sample", PX + "SELECT id, k::INT AS class FROM px QUALIFY row_number() OVER (PARTITION BY k ORDER BY (id % 2147483648 * 1103515245 + 12345) % 2147483648, id) <= 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(pixels(spark, sf_dir), "k", "id", 50).select("id", F.col("k").cast("int").alias("class"))


WAVELENGTHS = [2050.0 + 350.0 * k / 63 for k in range(64)]
_CUBE = "WITH cube AS (SELECT vec_id, list_transform(embedding, lambda x: 0.5e0 + 0.4e0 * x::DOUBLE) AS s FROM embeddings)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.lit(0.5) + F.lit(0.4) * x.cast("double")).alias("s"))


def _depth_sql(feature: tuple[float, float, float]) -> str | None:
    bands = hyperspectral.places(WAVELENGTHS, feature)
    if not bands:
        return None
    left, centre, right = (f"s[{k + 1}]" for k in bands)
    t = (WAVELENGTHS[bands[1]] - WAVELENGTHS[bands[0]]) / (WAVELENGTHS[bands[2]] - WAVELENGTHS[bands[0]])
    line = f"({left} * {1 - t!r}e0 + {right} * {t!r}e0)"
    return f"CASE WHEN {line} > 0.02e0 THEN 1 - {centre} / {line} ELSE 0e0 END"


def _minerals_sql() -> dict[str, str]:
    out = {}
    for name, main in hyperspectral.MAIN.items():
        if depth := _depth_sql(main):
            checks = [f"({depth}) >= 0.03e0"]
            checks += [f"({d}) {sense} ({depth}) * {share!r}e0" for m, f, sense, share in hyperspectral.CHECKS if m == name and (d := _depth_sql(f))]
            out[name] = f"CASE WHEN {' AND '.join(checks)} THEN {depth} ELSE 0e0 END"
    return out


@query("hyperspectral_band_depth", _CUBE + ", d AS (SELECT vec_id, " + ", ".join(f"{e} AS {k}" for k, e in _minerals_sql().items()) + " FROM cube) SELECT vec_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in _minerals_sql()) + " FROM d")
def hyperspectral_band_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hyperspectral.with_depths(cube(spark, sf_dir), "s", WAVELENGTHS)
    return made.select("vec_id", *[F.round(k, 6).alias(k) for k in hyperspectral.MAIN if k in made.columns])


@query("mineral_classes", _CUBE + ", d AS (SELECT vec_id, " + ", ".join(f"{e} AS {k}" for k, e in _minerals_sql().items()) + " FROM cube), m AS (SELECT *, greatest(" + ", ".join(_minerals_sql()) + ") AS top FROM d) SELECT vec_id, (CASE WHEN top < 0.03e0 THEN 0 " + " ".join(f"WHEN {k} = top THEN {i}" for i, k in enumerate(hyperspectral.MAIN, 1) if k in _minerals_sql()) + " END)::INT AS mineral FROM m")
def mineral_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hyperspectral.with_depths(cube(spark, sf_dir), "s", WAVELENGTHS)
    return made.select("vec_id", hyperspectral.deepest([m for m in hyperspectral.MAIN if m in made.columns]).cast("int").alias("mineral"))


@query("hyperspectral_area", _CUBE + ", d AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in _minerals_sql().items()) + " FROM cube) " + " UNION ALL ".join(f"SELECT '{k}' AS mineral, count(*) FILTER ({k} >= 0.03e0)::BIGINT AS pixels, count(*) FILTER ({k} >= 0.30e0)::BIGINT AS strong, round(count(*) FILTER ({k} >= 0.03e0) * 0.0009e0, 6) AS km2 FROM d" for k in _minerals_sql()))
def hyperspectral_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 30 m, strong ones and area of each mineral over a cube, from its depths."""
    made = hyperspectral.with_depths(cube(spark, sf_dir), "s", WAVELENGTHS)
    names = [m for m in hyperspectral.MAIN if m in made.columns]
    rows = made.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mineral"), F.col(m).alias("depth")) for m in names])))
    counts = rows.groupBy("mineral").agg(F.count_if(F.col("depth") >= hyperspectral.MIN_DEPTH).alias("pixels"), F.count_if(F.col("depth") >= 0.3).alias("strong"))
    return counts.withColumn("km2", F.round(F.col("pixels") * 0.0009, 6))


@query("hyperspectral_needed_bands", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {WAVELENGTHS[k]!r}e0)" for k in hyperspectral.needed_bands(WAVELENGTHS)) + ") AS t(band, nm)")
def hyperspectral_needed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a cube that any measurable absorption reads, found by the tables' nearest bands."""
    listed = F.transform(F.array(*[F.lit(w) for w in WAVELENGTHS]), lambda w, i: F.struct(i.alias("band"), w.alias("nm")))
    bands = spark.range(1).select(F.inline(listed))
    wanted = spark.createDataFrame([(float(nm), reach) for f in hyperspectral.measurable(WAVELENGTHS) for nm, reach in zip(f, hyperspectral.REACH)], "target double, reach double").distinct()
    near = F.broadcast(wanted).join(bands, F.abs(F.col("nm") - F.col("target")) <= F.col("reach"))  # a few dozen wavelengths
    best = near.groupBy("target", "reach").agg(F.min_by("band", F.struct(F.abs(F.col("nm") - F.col("target")), "band")).alias("band"))
    return bands.join(best.select("band").distinct(), "band", "left_semi").select("band", F.round("nm", 9).alias("nm"))


_SAM = _CUBE + """, t AS (SELECT list_transform(range(0, 64), lambda i: i / 63e0) AS t),
dep AS (SELECT vec_id, list_transform(range(1, 65), lambda i: 1 - s[i] / (greatest(s[1] * (1 - t[i]) + s[64] * t[i], s[i]) + 1e-6)) AS x FROM cube, t),
n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) + 1e-6 AS norm FROM dep),
a AS (SELECT p.vec_id, l.vec_id AS lib, acos(least(greatest(list_sum(list_transform(range(1, 65), lambda i: p.x[i] * l.x[i])) / p.norm / l.norm, -1e0), 1e0)) AS angle, list_max(p.x) AS deepest FROM n p, n l WHERE l.vec_id < 8)
SELECT vec_id, round(min(angle), 4) AS angle, (CASE WHEN min(angle) <= 0.25e0 AND any_value(deepest) >= 0.03e0 THEN arg_min(lib, angle) + 1 ELSE 0 END)::INT AS class FROM a GROUP BY vec_id"""


@query("sam_classify", _SAM)
def sam_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array(*[F.lit(k / 63) for k in range(64)])
    depths = cube(spark, sf_dir).withColumn("x", hyperspectral.removed_continuum(F.col("s"), t))
    library = F.broadcast(depths.filter("vec_id < 8").select(F.col("vec_id").alias("lib"), F.col("x").alias("y")))  # a library of eight spectra
    angles = depths.crossJoin(library).withColumn("angle", hyperspectral.angle(F.col("x"), F.col("y")))
    best = angles.groupBy("vec_id").agg(F.min("angle").alias("angle"), F.min_by("lib", F.struct("angle", "lib")).alias("lib"), F.first(F.array_max("x")).alias("deepest"))
    found = (F.col("angle") <= 0.25) & (F.col("deepest") >= 0.03)
    return best.select("vec_id", F.round("angle", 4).alias("angle"), F.when(found, F.col("lib") + 1).otherwise(0).cast("int").alias("class"))


@query("occurrence_parse", """WITH raw AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE (s_acctbal / 200)::VARCHAR END AS lat, (s_suppkey % 360 - 180)::VARCHAR AS lng,
    (['Iron Ore', ' copper', 'GOLD', 'unknown', 'Quartz Vein '])[s_suppkey % 5 + 1] AS commodity, s_name AS name FROM supplier)
SELECT name, round(lat::DOUBLE, 6) AS lat, lng::DOUBLE AS lon, trim(commodity) AS commodity, CASE lower(trim(commodity)) WHEN 'iron ore' THEN 'iron' WHEN 'copper' THEN 'copper' WHEN 'gold' THEN 'vein' WHEN 'quartz vein' THEN 'vein' END AS model
FROM raw WHERE trim(lat) <> ''""")
def occurrence_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Iron Ore", " copper", "GOLD", "unknown", "Quartz Vein ")])
    raw = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 11 == 0, " ").otherwise((F.col("s_acctbal") / 200).cast("string")).alias("Latitude"), (F.col("s_suppkey") % 360 - 180).cast("string").alias("LNG"),
        F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("Commodity"), F.col("s_name").alias("Name"),
    )
    return vectors.occurrences(raw, COMMODITY_MODELS, "commodity", plural=False).withColumn("lat", F.round("lat", 6))


@query("class_lookup_left_join", PX + ", v AS (SELECT id, CASE WHEN id % 10 = 0 THEN 42 ELSE label END AS label FROM surface) SELECT id, label::INT AS label, CASE label " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in (ROCKS | MASKS).items()) + " ELSE 'Class ' || label END AS name FROM v")
def class_lookup_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 10 == 0, 42).otherwise(F.col("label")).cast("int")
    named = surface(spark, sf_dir).select("id", label.alias("label")).join(F.broadcast(statistics.class_dimension(spark)), F.col("label") == F.col("class_id"), "left")
    return named.select("id", "label", F.coalesce("class_name", F.concat(F.lit("Class "), F.col("label").cast("string"))).alias("name"))


@query("unknown_values_anti", "SELECT p_size AS value, count(*)::BIGINT AS n FROM part WHERE p_size NOT IN (1, 2, 3, 4, 5, 6, 7) GROUP BY 1")
def unknown_values_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.broadcast(statistics.class_dimension(spark))
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(known, F.col("value") == F.col("class_id"), "left_anti")


@query("occurrence_union", "SELECT c_name AS name, c_acctbal AS score, NULL::VARCHAR AS commodity FROM customer UNION ALL SELECT s_name, s_acctbal, 'iron' FROM supplier")
def occurrence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return found.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), F.lit("iron").alias("commodity")), allowMissingColumns=True)


_JOBS = """WITH jobs AS (SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id % 50 END AS region,
    CASE WHEN length(text) % 3 = 0 THEN 'running' WHEN length(text) % 3 = 1 THEN 'queued' ELSE 'done' END AS status, length(text) * 3e0 AS heartbeat, (turn % 5)::INT AS attempts FROM conversations)"""


def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text") % 3
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 7 != 0, F.col("conv_id") % 50).alias("region"),
        F.when(size == 0, "running").when(size == 1, "queued").otherwise("done").alias("status"), (F.length("text") * 3.0).alias("heartbeat"), (F.col("turn") % 5).cast("int").alias("attempts"),
    )


@query("job_claim_candidates", _JOBS + "SELECT id, region, status, heartbeat, attempts FROM jobs j WHERE status = 'queued' AND (region IS NULL OR region NOT IN (SELECT region FROM jobs WHERE status = 'running' AND region IS NOT NULL))")
def job_claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claimable(job_table(spark, sf_dir))


@query("stale_jobs", _JOBS + "SELECT id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS next_status FROM jobs WHERE status = 'running' AND 1000 - heartbeat > 180")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stale(job_table(spark, sf_dir), 1000.0).select("id", "next_status")


@query("login_lock_out", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT // 60 RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) >= 5 AS locked FROM events WHERE event_type = 'error'")
def login_lock_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.col("user_id").alias("user"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("at"))
    return jobs.locked_out(failed).select("event_id", "locked")


@query("events_json_props", "SELECT event_type, (props->>'k')::INT % 10 AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def events_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").groupBy("event_type", (parsed["k"] % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("lineament_rose", "WITH s AS (SELECT (l_partkey * 7) % 180 AS strike, l_quantity * 20 AS len FROM lineitem) SELECT i::INT AS sector, round(coalesce(sum(len), 0) / 1000, 4) AS km FROM range(0, 12) t(i) LEFT JOIN s ON (strike // 15) % 12 = i GROUP BY i")
def lineament_rose(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 7) % 180).alias("strike"), (F.col("l_quantity") * 20).alias("length_m"))
    return lineaments.rose(lines).select("sector", F.round("km", 4).alias("km"))


@query("brightness_regression", "SELECT l_returnflag AS tile, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(median(l_extendedprice), 4) AS mid FROM lineitem GROUP BY 1")
def brightness_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tile"))
    return fit.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"), F.round(F.median("l_extendedprice"), 4).alias("mid"))


@query("xyz_tile_bounds", """WITH t AS (SELECT n_nationkey % 12 AS z, (n_nationkey * 5) % (1 << (n_nationkey % 12)) AS x, (n_nationkey * 3) % (1 << (n_nationkey % 12)) AS y FROM nation), b AS (SELECT *, 2 * 20037508.342789244e0 / pow(2, z) AS s FROM t)
SELECT z::INT AS z, x::INT AS x, y::INT AS y, round(x * s - 20037508.342789244e0, 4) AS "left", round(20037508.342789244e0 - y * s, 4) AS top, round(degrees(atan((exp(lat) - exp(-lat)) / 2)), 6) AS lat FROM (SELECT *, (20037508.342789244e0 - (y + 0.5e0) * s) / 20037508.342789244e0 * pi() AS lat FROM b)""")
def xyz_tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("n_nationkey") % 12
    tiles = table(spark, sf_dir, "nation").select(z.alias("z"), F.expr("(n_nationkey * 5) % shiftleft(1, n_nationkey % 12)").alias("x"), F.expr("(n_nationkey * 3) % shiftleft(1, n_nationkey % 12)").alias("y"))
    left, bottom, _, top = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return tiles.select("z", "x", "y", F.round(left, 4).alias("left"), F.round(top, 4).alias("top"), F.round(geo.tile_latitude(bottom, top), 6).alias("lat"))


@query("utm_round_trip", """SELECT s_suppkey, (floor((66e0 + s_suppkey % 17 + 180) / 6) + 1)::INT AS zone, 0e0 AS lon_error, 0e0 AS lat_error,
    CASE WHEN (66 + s_suppkey % 17 + 180) % 6 = 3 THEN 500000e0 END AS middle FROM supplier""")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of error, to the ninth decimal, of a walk to UTM and back; on a zone's middle meridian also the easting."""
    at = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(66.0) + F.col("s_suppkey") % 17).alias("lon"), (F.lit(20.0) + F.col("s_suppkey") % 41).alias("lat"))
    east, north = geo.to_utm(F.col("lon"), F.col("lat"), geo.utm_zone(F.col("lon")))
    there = at.withColumns({"zone": geo.utm_zone(F.col("lon")), "easting": east, "northing": north})
    lon, lat = geo.from_utm(F.col("easting"), F.col("northing"), F.col("zone"))
    middle = F.when((F.col("lon") + 180) % 6 == 3, F.round("easting", 4))
    return there.select("s_suppkey", "zone", F.round(F.abs(lon - F.col("lon")), 9).alias("lon_error"), F.round(F.abs(lat - F.col("lat")), 9).alias("lat_error"), middle.alias("middle"))


@query("stream_window_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, each id once, counted per type when all is read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days").dropDuplicates(["event_id", "ts"])
    folder = spark.conf.get("spark.checkpoint.dir", f"{spark.conf.get('spark.sql.warehouse.dir')}/streams")
    name = f"stream_{uuid.uuid4().hex}"
    return field.run_once(once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), name, f"{folder}/{name}", "complete")


@query("observation_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def observation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = field.windowed_counts(events, "ts", "event_type", "1 day")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
