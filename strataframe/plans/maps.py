"""Queries that turn class maps and scores into shapes, folds and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import BANDS
from ..operators import neighbourhood, polygons, presence, prospecting, spatial
from ..sources.pixels import WIDTH, table
from .raster import surface
from .registry import ORACLES, PX, query

#: Patches of the smoothed map: the lowest pixel of all that are reached by sides.  Holes follow from
#: corners, sides and cells (a patch is one piece), corners of rings from how many cells meet in a place.
_POLYGONS = ORACLES["majority_filter"].replace("WITH px0", "WITH RECURSIVE px0", 1).replace("SELECT r, c, (CASE", ", m AS (SELECT r, c, (CASE", 1) + """), hot AS (SELECT *, r * 100 + c AS node FROM m),
sides AS (SELECT a.node AS a, b.node AS b FROM hot a JOIN hot b ON a.label = b.label AND ((a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1))),
reach AS (SELECT node, node AS other FROM hot UNION SELECT reach.node, sides.b FROM reach JOIN sides ON sides.a = reach.other),
cells AS (SELECT hot.*, component FROM hot JOIN (SELECT node, min(other) AS component FROM reach GROUP BY node) USING (node)),
places AS (SELECT component, r + y AS y, c + x AS x, count(*) AS n, count(DISTINCT (x + y) % 2) AS odd FROM cells, range(2) a(y), range(2) b(x) GROUP BY component, r + y, c + x),
corners AS (SELECT component, count(*) AS v, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND odd = 1 THEN 2 ELSE 0 END) AS corners FROM places GROUP BY component),
edges AS (SELECT component, count(*) AS e FROM (SELECT DISTINCT component, r + y AS y, c AS x, 0 AS d FROM cells, range(2) a(y) UNION ALL SELECT DISTINCT component, r, c + x, 1 FROM cells, range(2) a(x)) GROUP BY component)
SELECT component, any_value(label)::INT AS label, count(*)::BIGINT AS pixels, (1 - (any_value(v) - any_value(e) + count(*)))::BIGINT AS holes,
       any_value(corners)::BIGINT AS corners, count(*)::DOUBLE AS area FROM cells JOIN corners USING (component) JOIN edges USING (component) GROUP BY component"""


@query("class_polygons", _POLYGONS)
def class_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of the smoothed class map as polygons: size, holes, corners of all rings, area within them."""
    smooth = neighbourhood.majority(surface(spark, sf_dir), "label", 3, "out").select("r", "c", F.col("out").cast("int").alias("label"))
    made = polygons.polygonise(smooth, "label", WIDTH)
    corners = F.aggregate(F.transform("rings", lambda ring: F.size(ring) - 1), F.lit(0), lambda a, n: a + n)
    return made.select("component", "label", "pixels", F.col("holes").cast("long").alias("holes"), corners.cast("long").alias("corners"), spatial.polygon_area(F.col("rings")).alias("area"))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable pixels of the 3 x 3 windows around a place for each nation: (occurrence, id, bands)."""
    k = F.col("n_nationkey").cast("long")
    places = table(spark, sf_dir, "nation").select(k.alias("occurrence"), (k * 37 % 97).alias("_c"), (k * 23 % 61).alias("_r"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cells = places.withColumn("_dr", steps).withColumn("_dc", steps).select("occurrence", (F.col("_r") + F.col("_dr")).alias("r"), (F.col("_c") + F.col("_dc")).alias("c"))
    return surface(spark, sf_dir).filter("usable").join(F.broadcast(cells), ["r", "c"]).select("occurrence", "id", *BANDS)


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.presence_table(_occurrences(spark, sf_dir), surface(spark, sf_dir).filter("usable"), "occurrence", "id", list(BANDS))


def _hash_sql(*values: str) -> str:
    out = "0"
    for v in values:
        out = f"((({out} * 31 + ({v})) % 2147483648) * 1103515245 + 12345) % 2147483648"
    return out


_PRESENCE = PX + f""", places AS (SELECT n_nationkey AS occurrence, (n_nationkey * 37) % 97 + dc AS c, (n_nationkey * 23) % 61 + dr AS r FROM nation, range(-1, 2) a(dr), range(-1, 2) b(dc)),
pos AS (SELECT id AS key, occurrence::BIGINT AS grp, 1 AS y, nir FROM places JOIN surface USING (r, c) WHERE usable),
bg AS (SELECT id AS key, -1 - ({_hash_sql("id + 1")}) % 5 AS grp, 0 AS y, nir FROM surface WHERE usable QUALIFY row_number() OVER (ORDER BY {_hash_sql("id")}, id) <= 20 * (SELECT count(*) FROM pos)),
rows_ AS (SELECT * FROM pos UNION ALL SELECT * FROM bg),
sizes AS (SELECT grp, count(*) AS n, {_hash_sql("abs(grp)", "(grp < 0)::BIGINT")} AS h FROM rows_ GROUP BY grp),
turns AS (SELECT grp, (row_number() OVER (ORDER BY n DESC, h, grp) - 1) % 10 AS turn FROM sizes),
dealt AS (SELECT rows_.*, least(turn, 9 - turn)::INT AS fold FROM rows_ JOIN turns USING (grp))"""


@query("presence_folds", _PRESENCE + "SELECT fold, count(DISTINCT grp)::BIGINT AS groups, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives FROM dealt GROUP BY fold")
def presence_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in each of five folds of occurrences against background."""
    dealt = presence.with_folds(_presence(spark, sf_dir))
    return dealt.groupBy("fold").agg(F.count_distinct("group").alias("groups"), F.sum("y").alias("positives"), F.sum(1 - F.col("y")).cast("long").alias("negatives"))


@query("presence_ranks", _PRESENCE + """SELECT a.fold, count(DISTINCT a.key * 100 + a.grp)::BIGINT AS positives, count(DISTINCT b.key)::BIGINT AS negatives, round(avg(CASE WHEN a.nir > b.nir THEN 1e0 WHEN a.nir = b.nir THEN 0.5e0 ELSE 0e0 END), 8) AS auc
FROM dealt a JOIN dealt b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY a.fold""")
def presence_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the near infrared alone ranks occurrences above background, fold by fold."""
    ranked = presence.rank_auc(presence.with_folds(_presence(spark, sf_dir)), "fold", "nir")
    return ranked.select("fold", "positives", "negatives", F.round("auc", 8).alias("auc"))


@query("presence_model")
def presence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by ranks of forests on folds of occurrences that they haven't seen; tests hold it against pairs."""
    return presence.fit(_presence(spark, sf_dir), list(BANDS), trees=20).folds


_SCORES = PX + """, sc AS (SELECT r, c, usable, least(100e0, 40e0 * k / 3 + (id * 37) % 23) AS iron, CASE WHEN k IN (2, 5) THEN 80e0 + (id * 13) % 19 ELSE 30e0 + (id * 7) % 31 END AS vein FROM surface),
ground AS (SELECT r, c, iron, vein, greatest(iron, vein) AS best FROM sc WHERE usable),
places AS (SELECT n_nationkey AS key, (n_nationkey * 23) % 61 AS r, (n_nationkey * 37) % 97 AS c, CASE WHEN n_regionkey < 3 THEN 'iron' ELSE 'vein' END AS model FROM nation),
occ AS (SELECT key, any_value(p.model) AS model, max(CASE WHEN usable THEN iron ELSE 0 END) AS iron, max(CASE WHEN usable THEN vein ELSE 0 END) AS vein, max(CASE WHEN usable THEN greatest(iron, vein) ELSE 0 END) AS best
    FROM places p JOIN sc ON abs(sc.r - p.r) <= 1 AND abs(sc.c - p.c) <= 1 WHERE EXISTS (SELECT 1 FROM px WHERE px.r = p.r AND px.c = p.c) GROUP BY key)"""
_RATES = "count(*) FILTER (pct IS NOT NULL)::BIGINT AS n, round(avg(pct), 6) AS auc, round(avg((pct >= 0.9)::INT), 6) AS top10, round(avg((pct >= 0.8)::INT), 6) AS top20"


def _model_sql(name: str, column: str, who: str, cut: str) -> str:
    return f"SELECT '{name}' AS model, (SELECT round(count(*) FILTER ({column} >= 75) * 0.0004e0, 6) FROM ground) AS high_km2, {cut} AS cutoff, {_RATES} FROM (SELECT (SELECT count(*) FROM ground g WHERE g.{column} <= o.{column}) / (SELECT count(*) FROM ground)::DOUBLE AS pct FROM occ o WHERE {who})"


@query("prospect_report", _SCORES + _model_sql("overall", "best", "true", "NULL::DOUBLE") + " UNION ALL " + " UNION ALL ".join(_model_sql(m, m, f"model = '{m}'", f"(SELECT round(least(99e0, greatest(75e0, quantile_cont({m}, 0.99))), 6) FROM ground)") for m in ("iron", "vein")))
def prospect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, cutoffs and how known occurrences rank, for two models and the best of them."""
    k, i = F.col("k"), F.col("id")
    iron = F.least(F.lit(100.0), F.lit(40.0) * k / 3 + (i * 37) % 23)
    vein = F.when(k.isin(2, 5), F.lit(80.0) + (i * 13) % 19).otherwise(F.lit(30.0) + (i * 7) % 31)
    scored = surface(spark, sf_dir).select("r", "c", "usable", "dem", iron.alias("iron"), vein.alias("vein"))
    n = F.col("n_nationkey").cast("long")
    points = table(spark, sf_dir, "nation").select(n.alias("key"), (n * 23 % 61).alias("r"), (n * 37 % 97).alias("c"), F.when(F.col("n_regionkey") < 3, "iron").otherwise("vein").alias("model"))
    made = prospecting.prospects(scored, ["iron", "vein"], WIDTH, points, least=2)
    return made.models.select("model", "n", *[F.round(c, 6).alias(c) for c in ("high_km2", "cutoff", "auc", "top10", "top20")])
