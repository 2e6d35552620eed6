"""Queries over the pixel relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral
from ..functions.classes import ALTERATION_WEIGHTS, BANDS, GEM_WEIGHTS, MINERAL_WEIGHTS
from ..functions.scalars import clip
from ..operators import halos, lineaments, neighbourhood, prospect, selection, spatial, statistics, targets
from ..sources.pixels import WIDTH, pixels
from .registry import PX, around, query

SIX = 6


def rounded(**columns: Column | str) -> list[Column]:
    return [F.round(F.col(v) if isinstance(v, str) else v, SIX).alias(k) for k, v in columns.items()]


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with ``lc`` (what hides the rock), ``label`` (rock or mask) and ``usable``."""
    return as_surface(pixels(spark, sf_dir))


def as_surface(px: DataFrame) -> DataFrame:
    px = px.withColumn("lc", spectral.landcover(F.col("scl")))
    return px.withColumn("label", F.when(F.col("lc") == 0, F.col("k")).otherwise(F.col("lc"))).withColumn("usable", (F.col("lc") == 0) & ~spectral.scl_masked(F.col("scl")))


@query("surface_area_stats", PX + """
, n AS (SELECT label, count(*) AS n FROM surface GROUP BY label),
classes(id, name, rock) AS (VALUES (1, 'Limestone / Carbonate', true), (2, 'Sandstone', true), (3, 'Shale / Mudstone', true), (4, 'Granite / Felsic Igneous', true),
    (5, 'Basalt / Mafic Igneous', true), (6, 'Metamorphic (Schist / Gneiss)', true), (7, 'Alluvium / Quaternary Deposits', true), (250, 'Snow / Glacier / Ice', false), (251, 'Water', false), (252, 'Dense vegetation', false), (253, 'Terrain shadow', false), (255, 'Cloud / no data', false))
SELECT id::INT AS class_id, name AS class_name, coalesce(n, 0)::BIGINT AS pixels, round(coalesce(n, 0) * (400 / 1e6), 6) AS km2,
       CASE WHEN rock THEN round(100e0 * coalesce(n, 0) / (SELECT sum(n) FROM n WHERE label <= 7), 6) END AS percent
FROM classes LEFT JOIN n ON label = id WHERE rock OR n IS NOT NULL
""")
def surface_area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics.area_statistics(surface(spark, sf_dir), "label")
    return stats.select("class_id", "class_name", "pixels", *rounded(km2="km2", percent="percent"))


@query("dn_to_reflectance_sensors", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, s AS sensor,
       round(least(greatest(l_extendedprice * CASE s WHEN 'landsat89' THEN 2.75e-5 ELSE 1e-4 END
           + CASE s WHEN 'sentinel2' THEN -0.1e0 WHEN 'landsat89' THEN -0.2e0 ELSE 0e0 END, 0e0), 1.5e0), 10) AS reflectance
FROM lineitem, (VALUES ('sentinel2'), ('sentinel2_legacy'), ('landsat89'), ('composite')) AS t(s)
""")
def dn_to_reflectance_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    each = F.array(*[F.struct(F.lit(s).alias("sensor"), F.round(spectral.to_reflectance(F.col("l_extendedprice"), s), 10).alias("reflectance")) for s in ("sentinel2", "sentinel2_legacy", "landsat89", "composite")])
    return items.select(*keys, F.inline(each))


_INDICES = """round(least(greatest((nir - red) / (nir + red + 1e-6), -10e0), 10e0), 6) AS ndvi, round(least(swir1 / (swir2 + 1e-6), 10e0), 6) AS clay,
    round(least(red / (blue + 1e-6), 10e0), 6) AS iron, round(least(swir1 / (nir + 1e-6), 10e0), 6) AS ferrous, round(least(red / (green + 1e-6), 10e0), 6) AS ferric,
    round((blue + green + red + nir + swir1 + swir2) / 6, 6) AS brightness, round((swir1 - nir) / (swir1 + nir + 1e-6), 6) AS bare"""


@query("spectral_indices", PX + f"SELECT id, {_INDICES} FROM px")
def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", *rounded(**spectral.spectral_indices()))


@query("alteration_ratios", PX + """SELECT id, round(swir1 / (swir2 + 1e-6), 6) AS clay, round(red / (blue + 1e-6), 6) AS iron_oxide,
    round(swir2 / (nir + 1e-6) + green / (red + 1e-6), 6) AS ferrous, round(swir1 / (red + 1e-6), 6) AS gossan FROM px""")
def alteration_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", *rounded(**spectral.alteration_ratios()))


@query("cluster_features", PX + f"""SELECT id, {", ".join(f"round({b} / ((blue + green + red + nir + swir1 + swir2) / 6 + 1e-6), 6) AS shape_{b}" for b in BANDS)},
    round(ln((blue + green + red + nir + swir1 + swir2) / 6 + 1e-6), 6) AS log_bright, {_INDICES} FROM px""")
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", *rounded(**spectral.cluster_features()))


@query("surface_masks", PX + """SELECT id, lc::INT AS landcover, scl IN (0, 1, 3, 8, 9, 10) AS scl_masked, (id % 128) & 31 <> 0 AS qa_masked,
    blue - 0.5e0 * red - 0.08e0 > 0 AND blue > 0.2e0 AND swir1 < 1.35e0 * blue AND (green - swir1) / (green + swir1 + 1e-6) < 0.4e0 AS hot_cloud, usable FROM surface""")
def surface_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir).select(
        "id", F.col("lc").cast("int").alias("landcover"), spectral.scl_masked(F.col("scl")).alias("scl_masked"), spectral.qa_masked(F.col("id") % 128).alias("qa_masked"),
        spectral.hot_cloud().alias("hot_cloud"), "usable",
    )


@query("dark_object_subtraction", PX + ", d AS (SELECT " + ", ".join(f"quantile_cont({b}, 0.005) AS d_{b}" for b in BANDS) + " FROM px) SELECT id, " + ", ".join(f"round(greatest({b} - d_{b}, 0e0), 6) AS {b}" for b in BANDS) + " FROM px, d")
def dark_object_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    dark = selection.quantile_row(px, {f"d_{b}": (F.col(b), 0.005) for b in BANDS})
    return statistics.with_row(px, dark).select("id", *rounded(**{b: F.greatest(F.col(b) - F.col(f"d_{b}"), F.lit(0.0)) for b in BANDS}))


@query("percentile_stretch", PX + ", d AS (SELECT quantile_cont(swir1, 0.02) AS lo, quantile_cont(swir1, 0.98) AS hi FROM px) SELECT id, floor(least(greatest((swir1 - lo) / (hi - lo + 1e-6), 0e0), 1e0) * 255)::INT AS grey FROM px, d")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    ends = selection.quantile_row(px, {"lo": (F.col("swir1"), 0.02), "hi": (F.col("swir1"), 0.98)})
    share = clip((F.col("swir1") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), 0.0, 1.0)
    return statistics.with_row(px, ends).select("id", (share * 255).cast("int").alias("grey"))


@query("normalizer_stats", PX + "SELECT " + ", ".join(f"round(avg({b}), 6) AS {b}_mean, round(stddev_pop({b}) + 1e-6, 6) AS {b}_std" for b in BANDS) + " FROM px")
def normalizer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics.z_stats(pixels(spark, sf_dir), {b: F.col(b) for b in BANDS})
    return stats.select(*rounded(**{c: c for c in stats.columns}))


_RATIOS = {"clay": "swir1 / (swir2 + 1e-6)", "iron_oxide": "red / (blue + 1e-6)", "ferrous": "swir2 / (nir + 1e-6) + green / (red + 1e-6)", "gossan": "swir1 / (red + 1e-6)"}
_ROBUST = ", v AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _RATIOS.items()) + " FROM surface), med AS (SELECT " + ", ".join(f"median({k}) AS {k}_median" for k in _RATIOS) + " FROM v WHERE usable), mad AS (SELECT " + ", ".join(f"greatest(median(abs({k} - {k}_median)) * 1.4826e0, 1e-3) AS {k}_scale" for k in _RATIOS) + " FROM v, med WHERE usable)"


@query("robust_z_stats", PX + _ROBUST + "SELECT " + ", ".join(f"round({k}_median, 6) AS {k}_median, round({k}_scale, 6) AS {k}_scale" for k in _RATIOS) + " FROM med, mad")
def robust_z_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics.robust_scales(surface(spark, sf_dir).filter("usable"), spectral.alteration_ratios())
    return stats.select(*rounded(**{c: c for c in stats.columns}))


_Z = {k: f"least(greatest(({k} - {k}_median) / {k}_scale, 0e0), 10e0)" for k in _RATIOS}
_WEIGHTED = {k: (z if k == "iron_oxide" else f"CASE WHEN (nir - red) / (nir + red + 1e-6) > 0.25e0 THEN 0e0 ELSE {z} END") for k, z in _Z.items()}
_ALTERATION = PX + _ROBUST + ", w AS (SELECT r, c, id, usable AND (blue + green + red + nir + swir1 + swir2) / 6 >= 0.08e0 AND (green - swir1) / (green + swir1 + 1e-6) <= 0.15e0 AS ok, " + ", ".join(f"({_WEIGHTED[k]}) * {ALTERATION_WEIGHTS[k]}e0 AS w_{k}" for k in _RATIOS) + " FROM v, med, mad), comb AS (SELECT *, w_clay + w_iron_oxide + w_ferrous + w_gossan AS v FROM w)" + around("comb", "avg(s.v) AS m", 1, "sm") + """, scored AS (
    SELECT id, comb.r, comb.c, CASE WHEN ok THEN least(greatest(m / 3e0 * 100, 0e0), 100e0) ELSE 0e0 END AS score,
           CASE WHEN NOT ok THEN 0 WHEN w_clay >= greatest(w_iron_oxide, w_ferrous, w_gossan) THEN 1 WHEN w_iron_oxide >= greatest(w_ferrous, w_gossan) THEN 2 WHEN w_ferrous >= w_gossan THEN 3 ELSE 4 END AS dominant
    FROM comb JOIN sm ON sm.r = comb.r AND sm.c = comb.c)"""


@query("alteration_score", _ALTERATION + "SELECT id, round(score, 4) AS score, dominant::INT AS dominant FROM scored")
def alteration_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = prospect.alteration_score(surface(spark, sf_dir), F.col("usable"))
    return scored.select("id", F.round("score", 4).alias("score"), "dominant")


_THRESHOLD = 22.0


@query("alteration_targets", _ALTERATION.replace("WITH px0", "WITH RECURSIVE px0", 1) + f""", hot AS (SELECT *, r * 100 + c AS node FROM scored WHERE score >= {_THRESHOLD}e0),
reach AS (
    SELECT node, node AS other FROM hot UNION
    SELECT reach.node, b.node FROM reach JOIN hot a ON a.node = reach.other JOIN hot b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1
), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
cells AS (SELECT hot.*, component FROM hot JOIN comp USING (node)),
kinds AS (SELECT component, arg_min(dominant, struct_pack(n := -n, d := dominant)) AS kind FROM (SELECT component, dominant, count(*) AS n FROM cells GROUP BY ALL) GROUP BY component)
SELECT component, count(*)::BIGINT AS pixels, round(count(*) * 0.04e0, 4) AS area_ha, round(avg(score), 4) AS mean_score, round(max(score), 4) AS peak_score,
       round(avg(c + 0.5e0), 4) AS x, round(avg(r + 0.5e0), 4) AS y, any_value(kind)::INT AS kind, round(avg(score) * log10(count(*) + 10), 4) AS rank_score
FROM cells JOIN kinds USING (component) GROUP BY component HAVING count(*) >= 3""")
def alteration_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = prospect.alteration_score(surface(spark, sf_dir), F.col("usable")).filter(F.col("score") >= _THRESHOLD).select("r", "c", "score", "dominant")
    found = targets.component_statistics(targets.connected(scored, WIDTH), "score", "dominant", 3)
    return found.select("component", "pixels", *[F.round(c, 4).alias(c) for c in ("area_ha", "mean_score", "peak_score", "x", "y")], "kind", F.round("rank_score", 4).alias("rank_score"))


_TERRAIN = PX + """, g AS (
    SELECT id, r, c, dem, coalesce((lead(dem) OVER x - lag(dem) OVER x) / 40, (lead(dem) OVER x - dem) / 20, (dem - lag(dem) OVER x) / 20) AS gx,
           coalesce((lead(dem) OVER y - lag(dem) OVER y) / 40, (lead(dem) OVER y - dem) / 20, (dem - lag(dem) OVER y) / 20) AS gy
    FROM px WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)
), sl AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(-gx, gy) AS aspect FROM g)"""


@query("terrain_features", _TERRAIN + around("px", "avg(s.dem) AS m", 2, "tpi") + """ SELECT id, round(dem / 1000, 6) AS elevation, round(degrees(slope) / 90, 6) AS steepness, round(sin(aspect), 6) AS aspect_sin, round(cos(aspect), 6) AS aspect_cos,
    round(least(greatest(sin(radians(45)) * cos(slope) + cos(radians(45)) * sin(slope) * cos(radians(315) - aspect), 0e0), 1e0), 6) AS hillshade, round(least(greatest((dem - m) / 50, -5e0), 5e0), 6) AS roughness
    FROM sl JOIN tpi ON tpi.r = sl.r AND tpi.c = sl.c""")
def terrain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = neighbourhood.slope_and_aspect(halos.with_kernels(pixels(spark, sf_dir), [halos.slopes("dz_dx", "dz_dy", "dem", 20.0), halos.mean("_m", "dem", 5)]))
    return made.select("id", *rounded(
        elevation=F.col("dem") / 1000, steepness=F.degrees("slope") / 90, aspect_sin=F.sin("aspect"), aspect_cos=F.cos("aspect"),
        hillshade=clip(neighbourhood.illumination(315.0, 45.0), 0.0, 1.0), roughness=clip((F.col("dem") - F.col("_m")) / 50, -5.0, 5.0),
    ))


_ILLUMINATED = _TERRAIN + ", il AS (SELECT sl.id, cos(radians(40)) * cos(slope) + sin(radians(40)) * sin(slope) * cos(radians(150) - aspect) AS cos_i, nir FROM sl JOIN px USING (id))"


@query("c_correction", _ILLUMINATED + """, f AS (SELECT regr_slope(nir, cos_i) AS b, regr_intercept(nir, cos_i) AS a, count(*) AS n FROM il WHERE cos_i > 0.05e0)
    SELECT id, round(cos_i, 6) AS cos_i, round(CASE WHEN n < 500 OR b <= 1e-6 THEN nir ELSE nir * least(greatest((cos(radians(40)) + greatest(a / b, 0e0)) / (greatest(cos_i, 0.05e0) + greatest(a / b, 0e0)), 0.3e0), 3e0) END, 6) AS nir FROM il, f""")
def c_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = neighbourhood.with_slope_and_aspect(pixels(spark, sf_dir)).withColumn("cos_i", neighbourhood.illumination(150.0, 50.0))
    fit = statistics.regression(lit.filter("cos_i > 0.05"), "nir", "cos_i")
    c = F.greatest(F.try_divide("intercept", "slope"), F.lit(0.0))
    factor = clip((F.cos(F.radians(F.lit(40.0))) + c) / (F.greatest("cos_i", F.lit(0.05)) + c), 0.3, 3.0)
    fixed = F.when((F.col("n") < 500) | (F.col("slope") <= 1e-6), F.col("nir")).otherwise(F.col("nir") * factor)
    return statistics.with_row(lit.drop("slope"), fit).select("id", *rounded(cos_i="cos_i", nir=fixed))


@query("box_mean_and_texture", PX + around("px", "avg(s.nir) AS m3", 1, "a") + around("px", "avg(s.nir * s.nir) - avg(s.nir) * avg(s.nir) AS tex", 2, "b") + "SELECT a.r, a.c, round(m3, 6) AS mean3, round(tex, 6) AS texture5 FROM a JOIN b ON a.r = b.r AND a.c = b.c")
def box_mean_and_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = neighbourhood.box(pixels(spark, sf_dir).withColumn("_sq", F.col("nir") * F.col("nir")), {"_m3": "nir"}, 3)
    px = neighbourhood.box(px, {"_m5": "nir", "_q5": "_sq"}, 5, first="r")
    return px.select("r", "c", *rounded(mean3="_m3", texture5=F.col("_q5") - F.col("_m5") * F.col("_m5")))


#: Mirrored pixels repeat ones that are in the window anyway, so that the largest and lowest don't need them.
_RELIEF = """, across AS (SELECT r, c, max(dem) OVER w AS hi, min(dem) OVER w AS lo FROM px WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
rel AS (SELECT r, c, max(hi) OVER w - min(lo) OVER w AS relief FROM across WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING))
"""


@query("relief_minmax", PX + _RELIEF + "SELECT r, c, round(relief, 6) AS relief FROM rel")
def relief_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = neighbourhood.box(neighbourhood.box(pixels(spark, sf_dir), {"_hi": "dem"}, 15, "max"), {"_lo": "dem"}, 15, "min", first="r")
    return px.select("r", "c", *rounded(relief=F.col("_hi") - F.col("_lo")))


@query("sobel_edges", PX + around("px", "sum(s.dem * dc * (2 - abs(dr))) AS gx, sum(s.dem * dr * (2 - abs(dc))) AS gy", 1, "a") + "SELECT r, c, round(sqrt(gx * gx + gy * gy), 4) AS edge FROM a")
def sobel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.sobel(pixels(spark, sf_dir), "dem", "edge").select("r", "c", F.round("edge", 4).alias("edge"))


@query("majority_filter", PX + around("surface", "s.label AS v, count(*) AS n", 1, "a", ", s.label, t.label AS own").replace("GROUP BY t.r, t.c, s.label, t.label AS own", "GROUP BY t.r, t.c, s.label, t.label").replace("SELECT t.r, t.c, s.label, t.label AS own, s.label AS v", "SELECT t.r, t.c, t.label AS own, s.label AS v") + """
SELECT r, c, (CASE WHEN any_value(own) = 0 OR any_value(own) >= 250 THEN any_value(own) ELSE arg_min(v, struct_pack(n := -n, v := v)) FILTER (v <= 7) END)::INT AS label FROM a GROUP BY r, c""")
def majority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.majority(surface(spark, sf_dir), "label", 3, "out").select("r", "c", F.col("out").cast("int").alias("label"))


@query("dilate_5", PX + "SELECT t.r, t.c, bool_or(coalesce(s.lc = 250, false)) AS near_snow FROM surface t LEFT JOIN surface s ON s.lc = 250 AND abs(s.r - t.r) + abs(s.c - t.c) <= 5 GROUP BY t.r, t.c")
def dilate_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = surface(spark, sf_dir).withColumn("snow", F.col("lc") == 250)
    return neighbourhood.dilate(df, "snow", 5, "near_snow").select("r", "c", "near_snow")


@query("contact_erosion", PX + """SELECT r, c, coalesce(lag(label) OVER x, label) = label AND coalesce(lead(label) OVER x, label) = label AND coalesce(lag(label) OVER y, label) = label AND coalesce(lead(label) OVER y, label) = label AS inside
    FROM surface WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)""")
def contact_erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood.inside_class(surface(spark, sf_dir), "label", "inside").select("r", "c", "inside")


# Patches of known rock in the raster: first and last row, first and last column, and the six bands.
_PLANTED = (
    ("marble", (2, 7, 20, 29), (0.42, 0.44, 0.40, 0.50, 0.60, 0.40)),
    ("ultramafic", (2, 7, 32, 41), (0.07, 0.09, 0.07, 0.07, 0.08, 0.12)),
    ("leucogranite", (2, 7, 44, 53), (0.52, 0.50, 0.55, 0.60, 0.52, 0.50)),
)


def _planted_sql() -> str:
    def band(k: int) -> str:
        cases = " ".join(f"WHEN r BETWEEN {a} AND {b} AND c BETWEEN {x} AND {y} THEN {spectrum[k]}e0" for _, (a, b, x, y), spectrum in _PLANTED)
        return f"CASE {cases} ELSE {BANDS[k]} END AS {BANDS[k]}"

    bands = ", ".join(band(k) for k in range(6))
    return PX.replace("), px AS (", "), plain AS (").replace("), hw AS (", f"), px AS (SELECT id, r, c, k, {bands}, dem, scl FROM plain), hw AS (")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels with patches of marble, ultramafic rock and leucogranite in them, as ``surface``."""
    px = pixels(spark, sf_dir)
    for k, name in enumerate(BANDS):
        value = F.col(name)
        for _, (a, b, x, y), spectrum in _PLANTED:
            value = F.when(F.col("r").between(a, b) & F.col("c").between(x, y), spectrum[k]).otherwise(value)
        px = px.withColumn(name, value)
    return as_surface(px)


_GEM = {"brightness": "(blue + green + red + nir + swir1 + swir2) / 6", "iron_ratio": "red / (blue + 1e-6)", "ferrous": "swir2 / (nir + 1e-6) + green / (red + 1e-6)", "swir_ratio": "swir1 / (swir2 + 1e-6)"}
_POS = lambda k: f"least(greatest(z_{k} / 3e0, 0e0), 1e0)"
_GEM_EVIDENCE = _planted_sql() + ", g0 AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _GEM.items()) + " FROM surface)" + around("g0", "avg(s.brightness * s.brightness) - avg(s.brightness) * avg(s.brightness) AS texture", 2, "tx") + ", g1 AS (SELECT g0.*, tx.texture FROM g0 JOIN tx ON tx.r = g0.r AND tx.c = g0.c), gm AS (SELECT " + ", ".join(f"median({k}) AS m_{k}" for k in (*_GEM, "texture")) + " FROM g1 WHERE usable), gs AS (SELECT " + ", ".join(f"greatest(median(abs({k} - m_{k})) * 1.4826e0, 1e-4) AS s_{k}" for k in (*_GEM, "texture")) + " FROM g1, gm WHERE usable), gz AS (SELECT g1.id, g1.r, g1.c, usable, " + ", ".join(f"({k} - m_{k}) / s_{k} AS z_{k}" for k in (*_GEM, "texture")) + f""" FROM g1, gm, gs), ge AS (SELECT id, r, c,
    CASE WHEN usable THEN least(greatest(z_swir_ratio / 2e0, 0e0), 1e0) * least(greatest((z_brightness + 1) / 2, 0e0), 1e0) * (1 - {_POS("iron_ratio")}) ELSE 0e0 END AS carbonate,
    CASE WHEN usable THEN {_POS("brightness")} * (1 - {_POS("swir_ratio")}) * (1 - {_POS("ferrous")}) * (1 - {_POS("iron_ratio")}) ELSE 0e0 END AS felsic,
    CASE WHEN usable THEN {_POS("ferrous")} * least(greatest((1 - z_brightness) / 2, 0e0), 1e0) ELSE 0e0 END AS mafic,
    CASE WHEN usable THEN {_POS("swir_ratio")} * least(greatest((1 - z_brightness) / 2, 0e0), 1e0) ELSE 0e0 END AS mgoh,
    CASE WHEN usable THEN {_POS("texture")} ELSE 0e0 END AS texture FROM gz)"""
#: Evidence with the rock map k, on slopes of 15 degrees, and contacts by the distance to the nearest strong cells.
_GEM_LITHOLOGY = _GEM_EVIDENCE + """, gg AS (SELECT id, coalesce((lead(dem) OVER x - lag(dem) OVER x) / 40, (lead(dem) OVER x - dem) / 20, (dem - lag(dem) OVER x) / 20) AS gx,
    coalesce((lead(dem) OVER y - lag(dem) OVER y) / 40, (lead(dem) OVER y - dem) / 20, (dem - lag(dem) OVER y) / 20) AS gy FROM px WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)),
gl AS (SELECT ge.id, ge.r, ge.c, greatest(carbonate, CASE WHEN k = 1 THEN 0.6e0 ELSE 0e0 END) AS carbonate, greatest(felsic, CASE WHEN k = 4 THEN 0.4e0 ELSE 0e0 END) AS felsic, greatest(mafic, CASE WHEN k = 5 THEN 0.5e0 ELSE 0e0 END) AS mafic, mgoh, texture,
    usable AND k <> 7 AND degrees(atan(sqrt(gx * gx + gy * gy))) >= 15e0 AS ok FROM ge JOIN surface USING (id) JOIN gg USING (id)),
sa AS (SELECT t.id, min((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c)) AS d FROM gl t, gl s WHERE s.ok AND s.carbonate > 0.6e0 GROUP BY t.id),
sb AS (SELECT t.id, min((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c)) AS d FROM gl t, gl s WHERE s.ok AND s.felsic > 0.6e0 GROUP BY t.id),
sm0 AS (SELECT t.id, min((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c)) AS d FROM gl t, gl s WHERE s.ok AND s.mafic > 0.6e0 GROUP BY t.id),
gc AS (SELECT gl.*, coalesce(exp(-(sqrt(sa.d) + sqrt(sm0.d)) * 20 / 160e0), 0e0) AS carb_contact, coalesce(exp(-(sqrt(sb.d) + sqrt(sm0.d)) * 20 / 160e0), 0e0) AS felsic_contact FROM gl LEFT JOIN sa USING (id) LEFT JOIN sb USING (id) LEFT JOIN sm0 USING (id)),
gk AS (SELECT r, c, """ + ", ".join(f"CASE WHEN ok THEN {k} ELSE 0e0 END AS {k}" for k in ("carbonate", "felsic", "mafic", "mgoh", "texture", "carb_contact", "felsic_contact")) + " FROM gc)"


@query("gem_evidence", _GEM_EVIDENCE + "SELECT id, " + ", ".join(f"round({k}, 4) AS {k}" for k in ("carbonate", "felsic", "mafic", "mgoh", "texture")) + " FROM ge")
def gem_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prospect.gem_evidence(planted(spark, sf_dir), F.col("usable"))
    return made.select("id", *[F.round(k, 4).alias(k) for k in ("carbonate", "felsic", "mafic", "mgoh", "texture")])


def _scores_sql(source: str, weights: dict, scale: dict | None = None) -> str:
    columns = ", ".join("(" + " + ".join(f"{k} * {w}e0" for k, w in parts.items()) + f") / {sum(parts.values())}e0 * {(scale or {}).get(m, '1e0')} AS raw_{m}" for m, parts in weights.items())
    means = ", ".join(f"avg(s.raw_{m}) AS {m}" for m in weights)
    out = ", ".join(f"round(least(greatest({m} * 100 / 0.7e0, 0e0), 100e0), 3) AS {m}" for m in weights)
    return f", sc AS (SELECT r, c, {columns} FROM {source})" + around("sc", means, 1, "sm") + f"SELECT r, c, {out} FROM sm"


@query("gem_model_scores", _GEM_LITHOLOGY + _scores_sql("gk", GEM_WEIGHTS))
def gem_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all models from evidence, rock map, bedrock and contacts."""
    size = halos.raster_size(pixels(spark, sf_dir))
    evidence = prospect.gem_evidence(planted(spark, sf_dir), F.col("usable"), [halos.slopes("dz_dx", "dz_dy", "dem", 20.0)], size)
    rock = neighbourhood.slope_and_aspect(evidence).withColumn("ok", F.col("usable") & prospect.bedrock())
    return prospect.gem_scores(prospect.with_lithology(rock, F.col("ok"), "k"), size).select("r", "c", *[F.round(m, 3).alias(m) for m in GEM_WEIGHTS])


_MINERAL = {"clay": _RATIOS["clay"], "iron_oxide": _RATIOS["iron_oxide"], "gossan": _RATIOS["gossan"], "brightness": _GEM["brightness"], "lineament": "density"}
#: Cells of a line, and the share of them that must be edges.
LINE_CELLS, LINE_SHARE = 9, 0.8


def _lines_sql() -> str:
    """Edges of four shades of relief, the best of twelve lines through each, density and distance of straight edges."""
    suns = (0, 45, 90, 135)
    shade = ", ".join(f"cos(radians(60)) * cos(slope) + sin(radians(60)) * sin(slope) * cos(radians({s}) - aspect) AS l{s}" for s in suns)
    sums = ", ".join(f"sqrt(pow(sum(s.l{s} * dc * (2 - abs(dr))), 2) + pow(sum(s.l{s} * dr * (2 - abs(dc))), 2)) AS s{s}" for s in suns)
    cells = ", ".join(f"({angle}, {dr}, {dc}, {len(line)})" for angle in range(lineaments.ANGLES) for line in [lineaments.kernel(LINE_CELLS, angle)] for dr, dc in line)
    return f""", lit AS (SELECT r, c, {shade} FROM sl)""" + around("lit", sums, 1, "sob") + f""",
cut AS (SELECT {", ".join(f"quantile_cont(s{s}, 0.85) AS q{s}" for s in suns)} FROM sob),
edges AS (SELECT r, c FROM sob, cut WHERE {" OR ".join(f"s{s} >= q{s}" for s in suns)}),
moves(angle, dr, dc, n) AS (VALUES {cells}),
votes AS (SELECT e.r - dr AS r, e.c - dc AS c, angle, count(*) / any_value(n)::DOUBLE AS v FROM edges e, moves GROUP BY ALL),
best AS (SELECT r, c, max(v) AS v FROM votes GROUP BY r, c),
ln AS (SELECT px.r, px.c, (e.r IS NOT NULL AND coalesce(round(b.v, 9), 0) >= {LINE_SHARE})::INT::DOUBLE AS line FROM px LEFT JOIN edges e USING (r, c) LEFT JOIN best b USING (r, c))""" + around("ln", "avg(s.line) * 50 AS density", 2, "dn") + """,
ld AS (SELECT t.r, t.c, sqrt(min((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c))) * 20 AS distance FROM ln t, ln s WHERE s.line = 1 GROUP BY t.r, t.c), lined AS (SELECT surface.*, density, distance FROM surface JOIN dn ON dn.r = surface.r AND dn.c = surface.c LEFT JOIN ld ON ld.r = surface.r AND ld.c = surface.c)"""


_MINERAL_EVIDENCE = _TERRAIN + _lines_sql() + ", v AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _MINERAL.items()) + " FROM lined), mm AS (SELECT " + ", ".join(f"median({k}) AS m_{k}" for k in _MINERAL) + " FROM v WHERE usable), ms AS (SELECT " + ", ".join(f"greatest(median(abs({k} - m_{k})) * 1.4826e0, 1e-4) AS s_{k}" for k in _MINERAL) + " FROM v, mm WHERE usable), mz AS (SELECT r, c, usable, distance, " + ", ".join(f"least(greatest((({k} - m_{k}) / s_{k}) / 3e0, 0e0), 1e0) AS p_{k}" for k in _MINERAL) + """ FROM v, mm, ms),
me AS (SELECT r, c, """ + ", ".join(f"CASE WHEN usable THEN {e} ELSE 0e0 END AS {k}" for k, e in {"clay": "p_clay", "iron_oxide": "p_iron_oxide", "gossan": "p_gossan", "silica": "p_brightness * (1 - p_iron_oxide)", "lineament": "p_lineament", "proximity": "coalesce(exp(-distance / 100e0), 0e0)"}.items()) + " FROM mz)"


@query("mineral_model_scores", _MINERAL_EVIDENCE + _scores_sql("me", MINERAL_WEIGHTS, {"vein": "least(greatest(silica + 0.4e0, 0e0), 1e0)"}))
def mineral_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from ratios and from density and nearness of lineaments in the relief."""
    size = halos.raster_size(pixels(spark, sf_dir))
    df = targets.settled(lineaments.lines(surface(spark, sf_dir), LINE_CELLS, least=LINE_SHARE, size=size))
    df = spatial.distances(lineaments.density(df, "line", 2, 20.0, "density", size), {"distance": "line"}, 20.0)
    scored = prospect.mineral_scores(prospect.mineral_evidence(df, F.col("usable"), "density", "distance"), size)
    return scored.select("r", "c", *[F.round(m, 3).alias(m) for m in MINERAL_WEIGHTS])


_HAZARD = _TERRAIN + _RELIEF + """, hz AS (SELECT sl.id, degrees(slope) AS deg, relief, label, (nir - red) / (nir + red + 1e-6) AS ndvi, wd.d AS river
    FROM sl LEFT JOIN (SELECT t.id, sqrt(min((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c))) * 20 AS d FROM surface t, surface s WHERE s.lc = 251 GROUP BY t.id) wd ON wd.id = sl.id JOIN rel ON rel.r = sl.r AND rel.c = sl.c JOIN surface ON surface.id = sl.id), hx AS (SELECT id, (
    0.40e0 * CASE WHEN deg <= 0 THEN 0e0 WHEN deg <= 10 THEN 0.01e0 * deg WHEN deg <= 20 THEN 0.1e0 + 0.03e0 * (deg - 10) WHEN deg <= 30 THEN 0.4e0 + 0.03e0 * (deg - 20) WHEN deg <= 40 THEN 0.7e0 + 0.025e0 * (deg - 30)
        WHEN deg <= 50 THEN 0.95e0 + 0.005e0 * (deg - 40) WHEN deg <= 90 THEN 1e0 - 0.0025e0 * (deg - 50) ELSE 0.9e0 END
    + 0.15e0 * least(relief / 400, 1e0) + 0.15e0 * coalesce(exp(-river / 400), 0e0) + 0.20e0 * CASE label WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.8e0 WHEN 4 THEN 0.3e0 WHEN 5 THEN 0.35e0 WHEN 6 THEN 0.6e0 WHEN 7 THEN 0.9e0 ELSE 0.5e0 END
    + 0.10e0 * (1 - least(greatest((ndvi - 0.1e0) / 0.5e0, 0e0), 0.7e0))) AS ix FROM hz)"""
_HAZARD_CLASS = "1 + (ix >= 0.35e0)::INT + (ix >= 0.50e0)::INT + (ix >= 0.65e0)::INT + (ix >= 0.80e0)::INT"


def _hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = [halos.slopes("dz_dx", "dz_dy", "dem", 20.0), halos.extreme("_hi", "dem", 15, "max"), halos.extreme("_lo", "dem", 15, "min")]
    df = neighbourhood.slope_and_aspect(halos.with_kernels(surface(spark, sf_dir), wide))
    df = spatial.distances(df.withColumn("_water", F.col("lc") == 251), {"_river": "_water"}, 20.0)
    return prospect.landslide(df, "label", F.degrees("slope"), F.col("_hi") - F.col("_lo"), F.col("_river"), spectral.normalized_difference(F.col("nir"), F.col("red")))


@query("landslide_classes", _HAZARD + f"SELECT id, round(ix, 6) AS hazard_index, ({_HAZARD_CLASS})::INT AS hazard FROM hx")
def landslide_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hazard(spark, sf_dir).select("id", F.round("hazard_index", SIX).alias("hazard_index"), "hazard")


@query("hazard_area", _HAZARD + f"SELECT ({_HAZARD_CLASS})::INT AS hazard, count(*)::BIGINT AS pixels, round(count(*) * 0.0004e0, 6) AS km2 FROM hx GROUP BY 1")
def hazard_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hazard(spark, sf_dir).groupBy("hazard").agg(F.count(F.lit(1)).alias("pixels")).select("hazard", "pixels", F.round(F.col("pixels") * 0.0004, SIX).alias("km2"))


@query("quartz_index", PX + "SELECT id, round(CASE WHEN red - 0.1e0 > 0 AND nir > 0 THEN swir1 * swir1 / ((red - 0.1e0) * nir) END, 6) AS qi FROM px")
def quartz_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("id", *rounded(qi=spectral.quartz_index(F.col("red") - 0.1, F.col("swir1"), F.col("nir"))))


@query("distance_decay", PX + "SELECT t.id, round(exp(-sqrt(min((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c))) * 20 / 80e0), 6) AS decay FROM surface t LEFT JOIN surface s ON s.lc = 251 GROUP BY t.id")
def distance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearness to water, from the exact distance however far."""
    near = spatial.distances(surface(spark, sf_dir).withColumn("water", F.col("lc") == 251), {"d": "water"}, 20.0)
    return near.select("id", *rounded(decay=F.exp(-F.col("d") / 80.0)))


@query("confusion_matrix", PX + ", ids AS (SELECT unnest(range(1, 8)) AS i) SELECT a.i::INT AS truth, b.i::INT AS predicted, count(p.id)::BIGINT AS n FROM ids a CROSS JOIN ids b LEFT JOIN surface p ON p.k = a.i AND p.label = b.i GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.confusion(surface(spark, sf_dir), "k", "label", list(range(1, 8)))


@query("kappa_metrics", """WITH m AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT sum(n) AS n, sum(n) FILTER (t = p) AS hit FROM m),
x AS (SELECT sum(n) FILTER (t = 0) AS t0, sum(n) FILTER (t = 1) AS t1, sum(n) FILTER (p = 0) AS p0, sum(n) FILTER (p = 1) AS p1, sum(n) FILTER (t = 0 AND p = 0) AS h0, sum(n) FILTER (t = 1 AND p = 1) AS h1 FROM m)
SELECT s.n::BIGINT AS n, round(hit::DOUBLE / n, 6) AS overall, round((hit::DOUBLE / n - (t0 * p0 + t1 * p1) / n::DOUBLE / n) / (1 - (t0 * p0 + t1 * p1) / n::DOUBLE / n), 6) AS kappa,
       round((2e0 * coalesce(h0, 0) / (t0 + p0) + 2e0 * coalesce(h1, 0) / (t1 + p1)) / 2, 6) AS macro_f1 FROM s, x""")
def kappa_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = statistics.confusion(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic", [0, 1])
    return statistics.accuracy(matrix).select("n", *rounded(overall="overall", kappa="kappa", macro_f1="macro_f1"))


@query("target_cutoffs", PX + "SELECT k::INT AS model, round(least(99e0, greatest(75e0, quantile_cont((id * 37) % 101 * 1e0, 0.99))), 6) AS cutoff FROM px GROUP BY k")
def target_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = ((F.col("id") * 37) % 101).cast("double")
    cuts = statistics.target_cutoff(pixels(spark, sf_dir), {str(k): F.when(F.col("k") == k, score) for k in range(1, 8)})
    each = F.array(*[F.struct(F.lit(k).alias("model"), F.round(str(k), SIX).alias("cutoff")) for k in range(1, 8)])
    return cuts.select(F.inline(each))


@query("success_rates", PX + """, b AS (SELECT (id * 37) % 101 AS s FROM px), o AS (SELECT (s_suppkey * 53) % 101 AS s FROM supplier),
p AS (SELECT o.s, (SELECT count(*) FROM b WHERE b.s <= o.s) / (SELECT count(*) FROM b)::DOUBLE AS pct FROM o)
SELECT count(*)::BIGINT AS n, round(avg(pct), 6) AS auc, round(avg((pct >= 0.9e0)::INT), 6) AS top10, round(avg((pct >= 0.8e0)::INT), 6) AS top20 FROM p""")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    background = pixels(spark, sf_dir).select(((F.col("id") * 37) % 101).cast("double").alias("score"))
    found = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(((F.col("s_suppkey") * 53) % 101).cast("double").alias("score"))
    rates = statistics.success_rates(found, background)
    return rates.select("n", *rounded(auc="auc", top10="top10", top20="top20"))


@query("overview_2x", PX + "SELECT r // 2 AS r, c // 2 AS c, round(avg(nir), 6) AS nir, arg_min(label, struct_pack(r := r, c := c))::INT AS label FROM surface GROUP BY r // 2, c // 2")
def overview_2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scenes import overview

    return overview(surface(spark, sf_dir), 2, ["nir"], ["label"]).select("r", "c", F.round("nir", SIX).alias("nir"), F.col("label").cast("int").alias("label"))
