"""Queries of the smaller steps: tiles, sources, checks, rankings, reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral
from ..functions.classes import BANDS, ROCKS
from ..functions.geo import MERCATOR
from ..functions.scalars import clip, finite, is_finite
from ..operators import datasets, grids, jobs, neighbourhood, sampling, scenes, statistics
from ..sources.pixels import pixels, table
from .raster import _INDICES, _TERRAIN, SIX, rounded, surface
from .registry import PX, around, query
from .relations import _JOBS, job_table

_BOX = "WITH b AS (SELECT n_nationkey AS k, (n_nationkey * 37) % 90 + 0.5e0 AS west, (n_nationkey * 23) % 70 + 0.25e0 AS south, (n_nationkey * 37) % 90 + 0.5e0 + 11 + n_nationkey AS east, (n_nationkey * 23) % 70 + 0.25e0 + 7 + n_nationkey % 9 AS north FROM nation)"
_TILES = _BOX + """, o AS (SELECT *, floor(west / 10) * 10 AS ox, ceil(north / 10) * 10 AS oy FROM b),
t AS (SELECT k, x AS tx, y AS ty, ox + x * 10 AS "left", oy - y * 10 - 10 AS bottom, ox + x * 10 + 10 AS "right", oy - y * 10 AS top FROM o, range(0, 20) a(x), range(0, 20) c(y) WHERE x < ceil((east - ox) / 10) AND y < ceil((oy - south) / 10)),
tiles AS (SELECT k, lpad(tx::VARCHAR, 3, '0') || '_' || lpad(ty::VARCHAR, 3, '0') AS tile, "left"::DOUBLE AS "left", bottom::DOUBLE AS bottom, "right"::DOUBLE AS "right", top::DOUBLE AS top, tx, ty FROM t)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    west, south = (k * 37) % 90 + F.lit(0.5), (k * 23) % 70 + F.lit(0.25)
    return table(spark, sf_dir, "nation").select(k.alias("k"), west.alias("west"), south.alias("south"), (west + 11 + k).alias("east"), (south + 7 + k % 9).alias("north"))


@query("tile_grid", _TILES + 'SELECT k, tile, "left", bottom, "right", top FROM tiles')
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = grids.tile_grid(_boxes(spark, sf_dir), "k", 10.0)
    return made.select("k", "tile", *[F.col(c).cast("double").alias(c) for c in ("left", "bottom", "right", "top")])


@query("tile_status", _TILES + """, s AS (SELECT DISTINCT s_nationkey AS k, lpad((s_suppkey % 4)::VARCHAR, 3, '0') || '_000' AS tile, 'done' AS status FROM supplier)
SELECT k, tile, coalesce(status, 'open') AS status, [["left", bottom], ["right", bottom], ["right", top], ["left", top], ["left", bottom]] AS ring FROM tiles LEFT JOIN s USING (k, tile)""")
def tile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprint of every tile with what has become of it."""
    tiles = grids.tile_grid(_boxes(spark, sf_dir), "k", 10.0)
    done = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lpad((F.col("s_suppkey") % 4).cast("string"), 3, "0"), F.lit("_000")).alias("tile"), F.lit("done").alias("status")).distinct()
    return tiles.join(done, ["k", "tile"], "left").select("k", "tile", F.coalesce("status", F.lit("open")).alias("status"), grids.footprint().alias("ring"))


@query("nested_bounds", "SELECT n_nationkey AS k, least(0e0, n_nationkey - 3e0) AS west, -(n_nationkey % 4) * 1e0 AS south, greatest(9e0, n_nationkey * 1e0) AS east, 5e0 + n_nationkey AS north FROM nation")
def nested_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of polygons of any number of rings."""
    k = F.col("n_nationkey").cast("double")
    point = lambda x, y: F.array(x, y)
    zero = F.lit(0.0)
    outer = F.array(point(zero, zero), point(F.lit(9.0), -(k % 4)), point(k, zero), point(zero, zero))
    inner = F.array(point(k - 3, zero), point(F.lit(1.0), k + 5), point(F.lit(1.0), zero), point(k - 3, zero))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), grids.nested_bounds(F.array(outer, inner)).alias("b")).select("k", "b.*")


@query("halo_counts", PX + "SELECT tr, tc, count(*)::BIGINT AS pixels, (count(*) FILTER (r // 16 = tr AND c // 16 = tc))::BIGINT AS own FROM px, range(0, 400) a(tr), range(0, 7) b(tc) WHERE r >= tr * 16 - 2 AND r < tr * 16 + 18 AND c >= tc * 16 - 2 AND c < tc * 16 + 18 GROUP BY tr, tc HAVING count(*) FILTER (r // 16 = tr AND c // 16 = tc) > 0")
def halo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that a tile of 16 holds with a halo of 2, and without."""
    spread = grids.with_halo(pixels(spark, sf_dir), 16, 2)
    counts = spread.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("pixels"), F.count_if("inner").alias("own"))
    return counts.filter("own > 0")


@query("window_crop", PX + "SELECT r - 3 AS r, c - 20 AS c, round(nir, 6) AS nir FROM px WHERE r BETWEEN 3 AND 42 AND c BETWEEN 20 AND 79")
def window_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.crop(pixels(spark, sf_dir), 3, 20, 40, 60).select("r", "c", *rounded(nir="nir"))


_TARGET = ", t AS (SELECT id, r, c, (c + 0.5e0) * 0.7e0 + 3 AS x, (r + 0.5e0) * 0.6e0 + 1 AS y FROM px)"


@query("align_nearest", PX + _TARGET + "SELECT t.id, round(s.nir, 6) AS nir FROM t LEFT JOIN px s ON s.r = floor(t.y) AND s.c = floor(t.x)")
def align_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster on another grid, each cell from the one it falls into."""
    px = pixels(spark, sf_dir)
    made = grids.resampled(px.select("id", "r", "c"), px.select("r", "c", "nir"), "nir", (F.col("c") + 0.5) * 0.7 + 3, (F.col("r") + 0.5) * 0.6 + 1)
    return made.select("id", *rounded(nir="nir"))


@query("align_bilinear", PX + _TARGET + """SELECT t.id, round(sum(s.dem * (1 - abs(t.y - 0.5e0 - s.r)) * (1 - abs(t.x - 0.5e0 - s.c))) / sum((1 - abs(t.y - 0.5e0 - s.r)) * (1 - abs(t.x - 0.5e0 - s.c))), 8) AS dem
    FROM t LEFT JOIN px s ON s.r BETWEEN floor(t.y - 0.5e0) AND floor(t.y - 0.5e0) + 1 AND s.c BETWEEN floor(t.x - 0.5e0) AND floor(t.x - 0.5e0) + 1 AND abs(t.y - 0.5e0 - s.r) < 1 AND abs(t.x - 0.5e0 - s.c) < 1 GROUP BY t.id""")
def align_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation on another grid, each cell from the four it lies between."""
    px = pixels(spark, sf_dir)
    made = grids.resampled(px.select("id", "r", "c"), px.select("r", "c", "dem"), "dem", (F.col("c") + 0.5) * 0.7 + 3, (F.col("r") + 0.5) * 0.6 + 1, "bilinear")
    return made.select("id", F.round("dem", 8).alias("dem"))


@query("scene_assets", "WITH a AS (SELECT l_orderkey AS cell, l_linenumber AS asset, round(l_extendedprice * 100)::BIGINT AS dn, l_quantity::INT % 12 AS code FROM lineitem) SELECT cell, " + ", ".join(f"sum(CASE WHEN asset = {i} THEN greatest(dn - 100000, 0) END)::DOUBLE / nullif(count(*) FILTER (asset = {i}) * 1000000e0, 0) AS {b}" for i, b in enumerate(BANDS, 1)) + ", max(CASE WHEN asset = 7 THEN code END)::INT AS scl FROM a GROUP BY cell")
def scene_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven single-band assets of a scene, each of its own rows, as one relation."""
    assets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("asset"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("dn"), (F.col("l_quantity").cast("int") % 12).alias("code"))
    return scenes.stacked(assets, ["cell"], "asset", "dn", "code", dict(enumerate(BANDS, 1)), scene_code=7, offset=-100000, scale=1000000)


@query("safe_bands", """WITH f AS (SELECT s_suppkey % 5 AS scene, 'T43_2024_' || (['B02', 'B03', 'B04', 'B8A', 'B11', 'B12', 'SCL'])[s_suppkey % 7 + 1] || (['_10m', '_20m', '', '_60m'])[s_suppkey % 4 + 1] || '.jp2' AS name FROM supplier)
SELECT scene, regexp_extract(name, '_(B[0-9A-Z]{2}|SCL)(_\\d+m)?\\.', 1) AS band, arg_min(name, (CASE WHEN contains(name, '_20m') THEN 'a' ELSE 'b' END) || name) AS name FROM f GROUP BY ALL""")
def safe_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each band of a scene: the wanted resolution first, then by name."""
    pick = lambda n, *x: F.get(F.array(*map(F.lit, x)), (F.col("s_suppkey") % n).cast("int"))
    files = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("scene"), F.concat(F.lit("T43_2024_"), pick(7, "B02", "B03", "B04", "B8A", "B11", "B12", "SCL"), pick(4, "_10m", "_20m", "", "_60m"), F.lit(".jp2")).alias("name"))
    return datasets.band_files(files, "scene", "name")


@query("spectral_library", "SELECT (0.4e0 + 0.01e0 * n_nationkey) * 1000 AS nm, m AS mineral, CASE WHEN (n_nationkey + i) % 6 <> 0 THEN round(n_nationkey * 0.01e0 + i, 6) END AS reflectance FROM nation, (VALUES ('kaolinite', 0), ('calcite', 1), ('alunite', 2)) AS t(m, i)")
def spectral_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (nm, mineral, reflectance) from lines of text whose first column is the wavelength; blanks are null."""
    k = F.col("n_nationkey")
    cell = lambda i: F.when((k + i) % 6 != 0, F.format_string("%.6f", k * F.lit(0.01) + i)).otherwise("")
    lines = table(spark, sf_dir, "nation").select(F.concat_ws(",", F.format_string("%.2f", F.lit(0.4) + F.lit(0.01) * k), cell(0), cell(1), cell(2)).alias("line"))
    return datasets.library_rows(lines, "line", ["kaolinite", "calcite", "alunite"])


@query("sensor_guess", "SELECT l_returnflag AS file, CASE WHEN quantile_cont(v, 0.99) <= 1.5 THEN 'reflectance' ELSE 'composite' END AS sensor, CASE WHEN median(v) > 2 THEN 0.0001e0 ELSE 1e0 END AS scale FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN l_tax + 0.01 ELSE l_extendedprice END AS v FROM lineitem) WHERE v > 0 GROUP BY 1")
def sensor_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of numbers a file has, from its 99th percentile, and the scale of a cube from its median."""
    value = F.when(F.col("l_returnflag") == "A", F.col("l_tax") + 0.01).otherwise(F.col("l_extendedprice"))
    return datasets.kind_and_scale(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), value.alias("v")), "file", "v")


@query("preset_boxes", "SELECT n_nationkey AS k, round(lon - d / cos(radians(lat)), 9) AS west, round(lat - d, 9) AS south, round(lon + d / cos(radians(lat)), 9) AS east, round(lat + d, 9) AS north FROM (SELECT n_nationkey, 70e0 + n_nationkey % 9 AS lon, 30e0 + n_nationkey % 8 AS lat, (10e0 + n_nationkey) / 111.32e0 AS d FROM nation)")
def preset_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of so many kilometres around a place, in degrees."""
    k = F.col("n_nationkey")
    box = datasets.box_around(F.lit(70.0) + k % 9, F.lit(30.0) + k % 8, F.lit(10.0) + k)
    return table(spark, sf_dir, "nation").select(k.alias("k"), *[F.round(v, 9).alias(n) for n, v in box.items()])


@query("feature_table", _TERRAIN + around("px", "avg(s.dem) AS m", 2, "tpi") + f""", ix AS (SELECT id, {_INDICES}, {", ".join(f"round({b}, 6) AS {b}" for b in BANDS)} FROM px)
SELECT id, [{", ".join(BANDS)}, ndvi, clay, iron, ferrous, ferric, brightness, bare, round(dem / 1000, 6), round(degrees(slope) / 90, 6), round(sin(aspect), 6), round(cos(aspect), 6),
    round(least(greatest(sin(radians(45)) * cos(slope) + cos(radians(45)) * sin(slope) * cos(radians(315) - aspect), 0e0), 1e0), 6), round(least(greatest((dem - m) / 50, -5e0), 5e0), 6)] AS features
FROM sl JOIN tpi ON tpi.r = sl.r AND tpi.c = sl.c JOIN ix USING (id)""")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra, indices and terrain in the order in which models read them."""
    made = neighbourhood.box(neighbourhood.with_slope_and_aspect(pixels(spark, sf_dir)), {"_m": "dem"}, 5)
    terrain = [F.col("dem") / 1000, F.degrees("slope") / 90, F.sin("aspect"), F.cos("aspect"), clip(neighbourhood.illumination(315.0, 45.0), 0.0, 1.0), clip((F.col("dem") - F.col("_m")) / 50, -5.0, 5.0)]
    values = [*(finite(F.col(b)) for b in BANDS), *spectral.spectral_indices().values(), *terrain]
    return made.select("id", F.array(*[F.round(v, SIX) for v in values]).alias("features"))


@query("mask_dispatch", "SELECT l_returnflag AS scene, l_linestatus AS sensor, CASE WHEN max(l_linenumber + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END) <= 11 AND l_linestatus = 'O' THEN 'scl' WHEN l_linestatus = 'F' THEN 'qa' ELSE 'binary' END AS rule FROM lineitem GROUP BY l_returnflag, l_linestatus")
def mask_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule reads a cloud layer: by its largest code and the sensor (O one family, F the other)."""
    code = F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 20).otherwise(0)
    layers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scene"), F.col("l_linestatus").alias("sensor")).agg(F.max(code).alias("top"))
    family = F.when(F.col("sensor") == "O", "sentinel2").when(F.col("sensor") == "F", "landsat89")
    return layers.select("scene", "sensor", F.coalesce(datasets.mask_rule(F.col("top"), family), F.lit("binary")).alias("rule"))


# Colours of the classes.
_COLORS = {1: "#4fa3e0", 2: "#f2c14e", 3: "#8c6d46", 4: "#e377c2", 5: "#3b3b3b", 6: "#2ca02c", 7: "#d9d9a3", 250: "#e8f4ff", 251: "#1f5fbf", 252: "#6aa84f", 253: "#555a66", 255: "#ffffff"}


@query("class_colours", PX + ", col(label, red8, green8, blue8) AS (VALUES " + ", ".join(f"({k}, {int(v[1:3], 16)}, {int(v[3:5], 16)}, {int(v[5:], 16)})" for k, v in _COLORS.items()) + ") SELECT id, red8::INT AS red8, green8::INT AS green8, blue8::INT AS blue8, CASE WHEN label = 255 THEN 0 ELSE 255 END AS alpha FROM surface JOIN col USING (label)")
def class_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red, green, blue and opacity of each pixel's class; no data is clear."""
    made = datasets.colours(surface(spark, sf_dir), "label", _COLORS).filter("alpha is not null")
    return made.select("id", "red8", "green8", "blue8", "alpha")


@query("dataset_checks", """WITH a AS (SELECT s_nationkey AS area, count(*) AS bands, max(s_suppkey % 3) AS crs, max(s_suppkey % 50) AS top FROM supplier GROUP BY 1), l AS (SELECT c_nationkey AS area, c_custkey % 11 AS v FROM customer WHERE c_nationkey % 4 <> 3),
p AS (SELECT area, 'few bands' AS problem FROM a WHERE bands < 6 UNION ALL SELECT area, 'no coordinate system' FROM a WHERE crs = 0 UNION ALL SELECT area, 'no overlap' FROM a WHERE top < 5
    UNION ALL SELECT area, 'no labels' FROM a WHERE area NOT IN (SELECT area FROM l) UNION ALL SELECT DISTINCT area, 'unknown class ' || v FROM l JOIN a USING (area) WHERE v NOT IN (0, 1, 2, 3, 4, 5, 6, 7))
SELECT area, problem FROM p""")
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would stop training on an area, one row a problem."""
    seen = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("bands"), (F.max(F.col("s_suppkey") % 3) > 0).alias("has_crs"), (F.max(F.col("s_suppkey") % 50) >= 5).alias("overlaps"))
    labels = table(spark, sf_dir, "customer").filter("c_nationkey % 4 != 3").select(F.col("c_nationkey").alias("area"), (F.col("c_custkey") % 11).alias("v"))
    return datasets.problems(seen, labels)


@query("newest_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_orderkey").desc()).limit(20)


@query("next_job", _JOBS + "SELECT id, region FROM jobs WHERE status = 'queued' AND (region IS NULL OR region NOT IN (SELECT region FROM jobs WHERE status = 'running' AND region IS NOT NULL)) ORDER BY id LIMIT 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queued job that is claimed next."""
    return jobs.claimable(job_table(spark, sf_dir)).orderBy("id").limit(1).select("id", "region")


@query("best_of_several", "SELECT n_regionkey AS region, arg_max(n_name, struct_pack(a := v, b := -n_nationkey)) AS largest, max(v)::BIGINT AS size FROM (SELECT n_regionkey, n_name, n_nationkey, count(c_custkey) AS v FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1")
def best_of_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The district with most pixels of each region; of equal ones the first."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("v"))
    each = table(spark, sf_dir, "nation").join(sizes, "n_nationkey", "left").fillna(0, ["v"])
    return datasets.largest(each.withColumnRenamed("n_regionkey", "region"), "region", "n_name", "v", "n_nationkey")


@query("coverage_of_tiles", PX + "SELECT count(*)::BIGINT AS tiles, round(avg(m), 6) AS coverage FROM (SELECT avg((scl IN (4, 5))::INT) AS m FROM px GROUP BY r // 16, c // 16)")
def coverage_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over tiles of each tile's own mean."""
    tile = [F.floor(F.col(axis) / 16) for axis in ("r", "c")]
    made = datasets.mean_of_tiles(pixels(spark, sf_dir), tile, F.col("scl").isin(4, 5))
    return made.select("tiles", F.round("coverage", SIX).alias("coverage"))


@query("distinct_dates", "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d')::INT AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def distinct_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as numbers, and the months they begin with, each once."""
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(F.date_format(at, "yyyyMMdd").cast("int").alias("day"), F.substring(F.date_format(at, "yyyy-MM-dd"), 1, 7).alias("month")).distinct()


@query("pooled_samples", PX + """, s AS (SELECT id, r // 8 AS tile, (['train', 'val', 'test'])[(r // 8 + c // 8) % 3 + 1] AS part, k, (id % 2147483648 * 1103515245 + 12345) % 2147483648 AS h FROM px), n AS (SELECT count(DISTINCT tile) AS n FROM s),
caps(part, cap) AS (VALUES ('train', 60), ('val', 500), ('test', 1000)), a AS (SELECT s.*, cap FROM s JOIN caps USING (part), n QUALIFY row_number() OVER (PARTITION BY tile, part, k ORDER BY h, id) <= ceil(cap * least(1e0, 3e0 / n))),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY part, k ORDER BY h, id) <= cap) SELECT id, part FROM b""")
def pooled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all tiles: a quota for each, then the cap of each class over all."""
    px = pixels(spark, sf_dir).withColumn("tile", F.floor(F.col("r") / 8))
    part = F.get(F.array(F.lit("train"), F.lit("val"), F.lit("test")), ((F.col("tile") + F.floor(F.col("c") / 8)) % 3).cast("int"))
    rows = px.withColumn("part", part)
    tiles = rows.agg(F.count_distinct("tile")).first()[0]
    return sampling.pooled(rows, "tile", "part", "k", "id", 60, tiles).select("id", "part")


@query("layers_everywhere", "SELECT l_returnflag AS layer, bool_and(n >= 5) AS everywhere, count(*)::BIGINT AS tiles FROM (SELECT l_returnflag, l_suppkey % 9 AS tile, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def layers_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every tile has enough bands of a layer."""
    bands = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layer"), (F.col("l_suppkey") % 9).alias("tile"), "l_linenumber")
    return datasets.layers_everywhere(bands, "layer", "tile", "l_linenumber", 5)


@query("zoom_hints", f"SELECT p_partkey AS k, greatest(0, least(18, round_even(log2(2 * {MERCATOR!r}e0 / 256 / (p_size * 3e0)), 0)))::INT AS zoom FROM part")
def zoom_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom level whose pixels are about as large as a resolution in metres."""
    level = F.bround(F.log2(F.lit(2 * MERCATOR / 256) / (F.col("p_size") * 3.0)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.greatest(F.lit(0.0), F.least(F.lit(18.0), level)).cast("int").alias("zoom"))


@query("finite_values", "SELECT event_id, isfinite(v) AS finite, CASE WHEN isnan(v) THEN 0e0 WHEN isinf(v) THEN sign(v) * 10 ELSE round(least(greatest(v, -10e0), 10e0), 6) END AS value FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value / 100 END AS v FROM events)")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    v = F.when(k == 0, F.lit(math.nan)).when(k == 1, F.lit(math.inf)).when(k == 2, F.lit(-math.inf)).otherwise(F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", is_finite(v).alias("finite"), F.round(clip(finite(v), -10.0, 10.0), SIX).alias("value"))


@query("text_parts", """SELECT s_suppkey AS k, split_part(s_name, '#', 2) AS number, ltrim(split_part(s_name, '#', 2), '0') AS bare, starts_with(s_name, 'Supplier') AS named, replace(s_name, '#', '-') AS dashed, substr(s_name || ' ' || s_name || ' ' || s_name, 1, 20) AS cut FROM supplier""")
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, strip, prefix, replace and cut, as file and granule names are read."""
    name, number = F.col("s_name"), F.get(F.split("s_name", "#"), F.lit(1))
    number = F.coalesce(number, F.lit(""))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), number.alias("number"), F.ltrim(number, F.lit("0")).alias("bare"), F.startswith(name, F.lit("Supplier")).alias("named"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("dashed"), F.left(F.concat_ws(" ", name, name, name), F.lit(20)).alias("cut"),
    )


@query("stamped_rows", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def stamped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text without a zone."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("hash_seeds", "SELECT c_custkey AS k, ('0x' || substr(sha1(c_name), 1, 8))::BIGINT AS seed, substr(sha256(c_name), 1, 12) AS key FROM customer")
def hash_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and cache keys cut from digests."""
    seed = F.conv(F.substring(F.sha1("c_name"), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), seed.alias("seed"), F.substring(F.sha2("c_name", 256), 1, 12).alias("key"))


@query("accuracy_warnings", """WITH m AS (SELECT s_nationkey AS model, count(*) AS n, avg((s_suppkey % 7 = s_suppkey * 3 % 7)::INT)::DOUBLE AS overall FROM supplier GROUP BY 1)
SELECT model, 'low accuracy' AS warning FROM m WHERE overall < 0.6 UNION ALL SELECT model, 'few pixels' FROM m WHERE n < 2000""")
def accuracy_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report warns of: accuracy below 0.6, fewer than 2,000 pixels."""
    hit = (F.col("s_suppkey") % 7 == F.col("s_suppkey") * 3 % 7).cast("int")
    models = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("overall"))
    return datasets.warnings(models, "model")


@query("rock_insights", PX + """, n AS (SELECT label, count(*) AS n FROM surface WHERE label <= 7 GROUP BY 1), t AS (SELECT label, n, round(100e0 * n / sum(n) OVER (), 0)::INT AS share, row_number() OVER (ORDER BY n DESC, label) AS place FROM n)
SELECT place::INT AS place, CASE label """ + " ".join(f"WHEN {k} THEN '{n}'" for k, n in ROCKS.items()) + " END || CASE WHEN place = 1 THEN ' is the dominant rock type (' ELSE ' comes next (' END || share || '%)' AS text FROM t WHERE place <= 3")
def rock_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most extensive rocks in words."""
    stats = statistics.area_statistics(surface(spark, sf_dir), "label").filter("class_id <= 7 and pixels > 0")
    top = stats.orderBy(F.col("pixels").desc(), "class_id").limit(3)
    numbered = top.agg(F.sort_array(F.collect_list(F.struct(-F.col("pixels"), "class_id", "class_name", "percent"))).alias("all")).select(F.posexplode("all").alias("at", "x"))
    verb = F.when(F.col("at") == 0, " is the dominant rock type (").otherwise(" comes next (")
    return numbered.select((F.col("at") + 1).alias("place"), F.concat("x.class_name", verb, F.round("x.percent").cast("int").cast("string"), F.lit("%)")).alias("text"))


@query("scene_choice", """WITH o AS (SELECT o_orderkey AS item, o_custkey % 6 AS granule, o_orderkey % 40 AS cell0, o_totalprice % 100 AS cloud, row_number() OVER (PARTITION BY o_custkey % 6 ORDER BY o_totalprice % 100, o_orderkey) AS place FROM orders),
q AS (SELECT * FROM o WHERE place <= 6), r AS (SELECT *, row_number() OVER (ORDER BY place, granule) AS turn FROM q), cells AS (SELECT turn, (cell0 + j * 7) % 120 AS cell FROM r, range(0, 9) t(j)), f AS (SELECT cell, min(turn) AS turn FROM cells GROUP BY cell),
cov AS (SELECT r.turn, (SELECT count(*) FROM f WHERE f.turn <= r.turn) / 120e0 AS covered FROM r), stop AS (SELECT coalesce(min(turn), 1000000) AS turn FROM cov WHERE covered >= 0.5e0 AND turn >= 2)
SELECT item, granule::INT AS granule, r.turn::INT AS turn, round(covered, 6) AS covered FROM r JOIN cov USING (turn), stop WHERE r.turn <= stop.turn""")
def scene_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes taken in turns over granules, at most six of each, until half of the cells are covered."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 6).alias("granule"), (F.col("o_orderkey") % 40).alias("cell0"), (F.col("o_totalprice") % 100).alias("cloud"))
    reads = o.withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: (F.col("cell0") + j * 7) % 120))
    return scenes.chosen(reads, "granule", "item", "cloud", "cells", 120, quota=6, share=0.5).select("item", F.col("granule").cast("int").alias("granule"), "turn", F.round("covered", SIX).alias("covered"))
