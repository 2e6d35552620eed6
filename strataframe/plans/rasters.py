"""Queries of overview pyramids, rasters between coordinate systems, cubes by file, and scene choice."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cubes, pyramid, targets, warp
from ..sources import cubes as cube_files
from ..sources.pixels import WIDTH, pixels, table
from ..streaming import composites
from .raster import surface
from .registry import ORACLES, PX, query
from .relations import WAVELENGTHS, cube

LEVELS = 4

_LEVEL = "SELECT {k}::INT AS level, r // {f} AS r, c // {f} AS c, round(round(sum(round(nir * 1000))) / count(*) + 1e-6, 4) AS nir, arg_min(label, struct_pack(r := r, c := c))::INT AS label FROM surface GROUP BY r // {f}, c // {f}"


@query("overview_pyramid", PX + " UNION ALL ".join(_LEVEL.format(k=k, f=2**k) for k in range(1, LEVELS + 1)))
def overview_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels of overviews of a band and of the class map."""
    made = pyramid.pyramid(surface(spark, sf_dir), LEVELS, ["nir"], ["label"])
    # thousandths of whole numbers over powers of two: a little is added so that no half is rounded
    return made.select("level", "r", "c", F.round(F.col("nir") * 1000 + 1e-6, 4).alias("nir"), F.col("label").cast("int").alias("label"))


#: The pixel view as a raster of UTM zone 43, and a coarser grid of the next zone to the west; rows have no end.
_SOURCE = warp.Grid(32643, 230000.0, 4000000.0, 20.0, WIDTH, 1 << 40)
_COARSE = warp.Grid(32642, 765000.0, 4010000.0, 70.0, 200, 1 << 40)


def _series(terms: tuple[float, ...], name: str, outer: str, inner: str, sign: str) -> str:
    return name + "".join(f" {sign} ({a!r}) * {outer}({2 * j} * xi0) * {inner}({2 * j} * eta0)" for j, a in enumerate(terms, 1))


def _warp_sql() -> str:
    scale, e = 0.9996 * geo._RADIUS, 2 * math.sqrt(geo._N) / (1 + geo._N)
    s, t = _SOURCE, _COARSE
    lat = "chi" + "".join(f" + ({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(geo._DELTA, 1))
    return (
        PX + f""", a AS (SELECT nir, ({s.top!r} - (r + 0.5e0) * {s.pixel!r}) / {scale!r} AS xi0, ({s.left!r} + (c + 0.5e0) * {s.pixel!r} - 500000e0) / {scale!r} AS eta0 FROM px),
b AS (SELECT nir, {_series(geo._BETA, "xi0", "sin", "cosh", "-")} AS xi, {_series(geo._BETA, "eta0", "cos", "sinh", "-")} AS eta FROM a),
d AS (SELECT nir, xi, eta, asin(sin(xi) / cosh(eta)) AS chi FROM b),
g AS (SELECT nir, {lat} AS phi, radians(75 - 69) + atan2(sinh(eta), cos(xi)) AS lam FROM d),
h AS (SELECT nir, lam, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS t FROM g),
i AS (SELECT nir, atan2(t, cos(lam)) AS xi0, atanh(sin(lam) / sqrt(1 + t * t)) AS eta0 FROM h),
j AS (SELECT nir, 500000 + {scale!r} * ({_series(geo._ALPHA, "eta0", "cos", "sinh", "+")}) AS x, {scale!r} * ({_series(geo._ALPHA, "xi0", "sin", "cosh", "+")}) AS y FROM i)
SELECT r, c, round(avg(nir), 8) AS nir, count(*)::BIGINT AS n FROM (SELECT nir, floor(({t.top!r} - y) / {t.pixel!r})::BIGINT AS r, floor((x - {t.left!r}) / {t.pixel!r})::BIGINT AS c FROM j) WHERE r >= 0 AND c BETWEEN 0 AND {t.width - 1} GROUP BY r, c"""
    )


@query("warp_average", _warp_sql())
def warp_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band of zone 43 averaged into the coarser cells of zone 42."""
    return warp.averaged(pixels(spark, sf_dir), "nir", _SOURCE, _COARSE).select("r", "c", F.round("nir", 8).alias("nir"), "n")


@query("cube_areas", ORACLES["hyperspectral_area"])
def cube_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of minerals from cubes by file: spectra are written by blocks of lines, needed bands read back and mapped."""
    placed = cube(spark, sf_dir).select(F.expr(f"vec_id div {WIDTH}").alias("r"), (F.col("vec_id") % WIDTH).alias("c"), "s")
    folder = f"{targets.shared_folder(spark)}/cubes-{uuid.uuid4().hex}"
    cube_files.write_cubes(placed, folder, "s", WAVELENGTHS, WIDTH, lines=64, dtype="f8", nodata=-1.0).agg(F.sum("pixels")).first()
    areas = cubes.mineral_areas(cubes.mineral_map(spark, folder, scale=1.0))
    return areas.select("mineral", "pixels", "strong", F.round("km2", 6).alias("km2"))


_CELLS = 120
_CHOICE = f"""WITH RECURSIVE o AS (SELECT o_custkey % 400 AS tile, o_orderkey AS item, 'g' || (o_custkey // 400 % 3) AS granule, o_totalprice % 100 AS cloud,
    CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 11 = 0 THEN []::BIGINT[] ELSE list_distinct(list_transform(range(0, 40), lambda j: (o_orderkey * 13 + j * 3) % {_CELLS})) END AS cells, o_orderkey % 22 = 0 AS snow FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud, item) AS rank, row_number() OVER (PARTITION BY tile, granule ORDER BY cloud, item) AS place FROM o),
f AS (SELECT *, min(rank) OVER (PARTITION BY tile, granule) AS first FROM k),
s AS (SELECT tile, item, granule, cells, snow, row_number() OVER (PARTITION BY tile ORDER BY place, first) - 1 AS turn, dense_rank() OVER (PARTITION BY tile ORDER BY granule) AS g FROM f),
m AS (SELECT tile, list(n ORDER BY granule) AS sizes, greatest(2, least(6, ceil(18e0 / count(*)))) AS quota FROM (SELECT tile, granule, count(*) AS n FROM o GROUP BY ALL) GROUP BY tile),
run AS (
    SELECT tile, -1::BIGINT AS turn, list_transform(sizes, lambda x: 0) AS used, list_transform(sizes, lambda x: 0) AS tried, []::BIGINT[] AS covered, 0 AS taken, false AS stopped, false AS took FROM m
    UNION ALL
    SELECT tile, turn, CASE WHEN takes THEN list_transform(used, lambda x, i: x + (i = g)::INT) ELSE used END,
           CASE WHEN passed OR stops THEN tried ELSE list_transform(tried, lambda x, i: x + CASE WHEN i <> g THEN 0 WHEN cells IS NOT NULL AND len(cells) = 0 AND NOT snow THEN 7 ELSE 1 END) END,
           CASE WHEN takes THEN list_distinct(list_concat(covered, cells)) ELSE covered END, taken + takes::INT, stops, takes
    FROM (SELECT *, NOT passed AND NOT stops AND cells IS NOT NULL AND (len(cells) > 0 OR snow) AS takes
          FROM (SELECT *, NOT passed AND taken >= 2 AND len(covered) >= 0.9e0 * {_CELLS} AND list_bool_and(list_transform(sizes, lambda n, i: used[i] >= least(2, n) OR tried[i] >= 3)) AS stops
                FROM (SELECT s.*, m.sizes, run.used, run.tried, run.covered, run.taken, run.used[s.g] >= m.quota OR run.tried[s.g] >= 3 * m.quota AS passed
                      FROM run JOIN s ON s.tile = run.tile AND s.turn = run.turn + 1 JOIN m ON m.tile = s.tile WHERE NOT run.stopped)))
)
SELECT tile, turn, granule, item, len(covered) / {_CELLS}e0 AS covered FROM run JOIN s USING (tile, turn) WHERE took"""


def candidate_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes of 400 tiles of 120 cells, in turns over granules."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("tile"), key.alias("item"), F.concat(F.lit("g"), F.expr("o_custkey div 400 % 3")).alias("granule"), (F.col("o_totalprice") % 100).alias("cloud"), "o_orderstatus")
    seen = o.filter("item % 11 != 0 and o_orderstatus != 'P'").select("tile", "item", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("_j"))
    words = composites.clear_words(seen.select("tile", "item", ((F.col("item") * 13 + F.col("_j") * 3) % _CELLS).alias("cell")))
    none = F.array().cast("array<struct<word:int,bits:bigint>>")
    turned = composites.in_turns(o, [F.col("cloud"), F.col("item")]).join(words, ["tile", "item"], "left")
    clear = F.when(F.col("o_orderstatus") != "P", F.coalesce("clear", none))
    return turned.select("tile", "turn", "granule", "item", "granules", clear.alias("clear"), (F.col("item") % 22 == 0).alias("snow"), F.lit(_CELLS).alias("cells"))


@query("composite_choice", _CHOICE)
def composite_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes that a composite of each tile takes, by quota and tries of granules, until nine tenths are covered."""
    return composites.choose(candidate_scenes(spark, sf_dir), enough=0.9)
