"""Training areas and incoming files: what is there, what kind of numbers it holds, what is wrong with it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral
from ..functions.classes import BANDS, ROCKS

# Names of the files of an area, the first found counts.
FILES = {
    "image": ("image.tif", "image.tiff"),
    "label_raster": ("labels.tif", "labels.tiff"),
    "label_vector": ("labels.geojson", "labels.json"),
    "dem": ("dem.tif", "dem.tiff"),
    "settings": ("area.json",),
    "sample": ("SAMPLE_DATA.txt",),
}


def files_under(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def areas_of(files: DataFrame, folder: str) -> DataFrame:
    """(area, image, labels, labels_kind, dem, settings, is_sample) of the areas among files (path).

    An area is a folder directly below ``folder`` that holds an image, or ``folder`` itself, which then
    is the only one.  A raster of labels comes before a vector file.  Deeper folders don't count.
    """
    root = folder.rstrip("/")
    inner = F.substring_index("path", f"{root.rpartition('/')[2]}/", -1)
    parts = F.split(inner, "/")
    named = files.filter(F.contains("path", F.lit(f"{root.removeprefix('file:').lstrip('/')}/"))).select("path", parts.alias("_p")).filter(F.size("_p") <= 2)
    placed = named.select("path", F.when(F.size("_p") == 2, F.col("_p")[0]).alias("area"), F.element_at("_p", -1).alias("name"))
    first = [F.min_by("path", F.when(F.col("name").isin(*names), F.array_position(F.array(*map(F.lit, names)), F.col("name")))).alias(kind) for kind, names in FILES.items()]
    found = placed.groupBy("area").agg(*first).filter("image is not null")
    alone = found.select(F.max(F.col("area").isNull()).alias("_alone"))  # one row
    kept = found.crossJoin(alone).filter(~F.col("_alone") | F.col("area").isNull())
    kind = F.when(F.col("label_raster").isNotNull(), "raster").when(F.col("label_vector").isNotNull(), "vector")
    return kept.select(
        F.coalesce("area", F.lit(root.rpartition("/")[2])).alias("area"), "image", F.coalesce("label_raster", "label_vector").alias("labels"), kind.alias("labels_kind"),
        "dem", "settings", F.col("sample").isNotNull().alias("is_sample"),
    )


def problems(areas: DataFrame, labels: DataFrame, known: tuple[int, ...] = (0, *ROCKS), least: int = len(BANDS), masks_from: int = 250) -> DataFrame:
    """(area, problem), one row for each thing that would stop training on an area.

    ``areas`` are (area, bands, has_crs, overlaps), ``labels`` (area, v) of labelled pixels; values from
    ``masks_from`` on are masks.  Labels of other areas and null labels are passed over.
    """
    own = [("few bands", F.col("bands") < least), ("no coordinate system", ~F.col("has_crs")), ("no overlap", ~F.col("overlaps"))]
    found = areas.select("area", F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in own]))).alias("problem"))
    values = labels.filter("v is not null").select("area", "v").distinct()
    unlabelled = areas.join(values.select("area"), "area", "left_anti").select("area", F.lit("no labels").alias("problem"))
    strange = values.filter(~F.col("v").isin(*known) & (F.col("v") < masks_from)).join(areas.select("area"), "area", "left_semi")
    return found.unionByName(unlabelled).unionByName(strange.select("area", F.concat(F.lit("unknown class "), F.col("v").cast("string")).alias("problem")))


def band_files(files: DataFrame, scene: str, name: str, wanted: str = "_20m") -> DataFrame:
    """(scene, band, name): the file of each band, those of the wanted resolution first, then by name."""
    found = files.withColumn("band", F.regexp_extract(name, r"_(B[0-9A-Z]{2}|SCL)(_\d+m)?\.", 1)).filter("band != ''")
    return found.groupBy(scene, "band").agg(F.min_by(name, F.struct(~F.contains(name, F.lit(wanted)), name)).alias(name))


def library_rows(lines: DataFrame, line: str, names: list[str]) -> DataFrame:
    """(nm, mineral, reflectance) from lines of text: micrometres, then a value for each name; blanks are null."""
    parts = F.split(line, ",")
    value = lambda i: F.when(F.trim(F.get(parts, i)) != "", F.get(parts, i).cast("double"))
    each = F.array(*[F.struct(F.lit(m).alias("mineral"), value(i).alias("reflectance")) for i, m in enumerate(names, 1)])
    return lines.select(F.round(F.get(parts, 0).cast("double") * 1000, 6).alias("nm"), F.inline(each))


def at_most(value: str | Column, q: float, limit: float) -> Column:
    """An aggregate: whether the q-quantile, between neighbours by straight lines, is at most ``limit``.

    Counts on both sides of the limit decide, and its two neighbours where the quantile lies between
    them, so that no value is sorted or kept.  Null counts for nothing; null if there is no value.
    """
    v = F.col(value) if isinstance(value, str) else value
    low, high = F.when(v <= limit, v), F.when(v > limit, v)
    place = (F.count(v) - 1) * F.lit(q)
    k = F.floor(place)
    between = F.max(low) + (place - k) * (F.min(high) - F.max(low)) <= limit
    below = F.count(low)
    return F.when(F.count(v) > 0, (below >= k + 2) | (below == k + 1) & ((below == F.count(v)) | between))


def kind_and_scale(rows: DataFrame, file: str, value: str) -> DataFrame:
    """(file, sensor, scale) from the positive values of each file: 'reflectance' up to 1.5, 'composite' above.

    The scale of a cube is 1e-4 where its median is above 2.
    """
    kind = F.when(at_most(value, 0.99, 1.5), "reflectance").otherwise("composite")
    return rows.filter(F.col(value) > 0).groupBy(file).agg(kind.alias("sensor"), F.when(at_most(value, 0.5, 2.0), 1.0).otherwise(1e-4).alias("scale"))


def mask_rule(top: Column, sensor: Column) -> Column:
    """'scl', 'qa' or 'binary': how a cloud layer is read, by its largest code and the sensor."""
    return F.when((top <= 11) & F.startswith(sensor, F.lit("sentinel2")), "scl").when(F.startswith(sensor, F.lit("landsat")), "qa").otherwise("binary")


def masked(pixels: DataFrame, code: str | None, rule: Column | None = None, threshold: float | None = 0.08) -> DataFrame:
    """Adds ``valid``: finite bands, not all zero, and no cloud by the rule of the layer, or by haze without one."""
    if code is None:
        cloud = F.coalesce(spectral.hot_cloud(threshold), F.lit(False)) if threshold is not None else F.lit(False)
    else:
        layer = F.nanvl(F.col(code).cast("double"), F.lit(None).cast("double"))  # NaN is missing
        whole = layer.cast("long")
        cloud = F.when(rule == "scl", spectral.scl_masked(whole)).when(rule == "qa", spectral.qa_masked(whole)).otherwise(F.coalesce(layer > 0, F.lit(False)))
    return pixels.withColumn("valid", spectral.valid(cloud))


def box_around(lon: Column, lat: Column, km: Column) -> dict[str, Column]:
    """West, south, east and north of a square of ``km`` to each side of a place, in degrees."""
    tall = km / 111.32
    wide = tall / F.cos(F.radians(lat))
    return {"west": lon - wide, "south": lat - tall, "east": lon + wide, "north": lat + tall}


def layers_everywhere(bands: DataFrame, layer: str, tile: str, band: str, least: int) -> DataFrame:
    """(layer, everywhere, tiles): whether every tile has at least so many bands of a layer."""
    each = bands.groupBy(layer, tile).agg(F.count_distinct(band).alias("_n"))
    return each.groupBy(layer).agg(F.bool_and(F.col("_n") >= least).alias("everywhere"), F.count(F.lit(1)).alias("tiles"))


def mean_of_tiles(pixels: DataFrame, tile: list[Column], share: Column) -> DataFrame:
    """(tiles, coverage): mean over tiles of each tile's own mean of a share; tiles without any don't count."""
    each = pixels.groupBy(*tile).agg(F.avg(share.cast("double")).alias("_m")).filter("_m is not null")
    return each.agg(F.count(F.lit(1)).alias("tiles"), F.avg("_m").alias("coverage"))


def largest(rows: DataFrame, group: str, name: str, size: str, tie: str) -> DataFrame:
    """(group, largest, size): the name with the largest size of each group; of equal ones the least ``tie``."""
    return rows.groupBy(group).agg(F.max_by(name, F.struct(size, -F.col(tie))).alias("largest"), F.max(size).alias("size"))


def warnings(models: DataFrame, model: str, overall: float = 0.6, least: int = 2000) -> DataFrame:
    """(model, warning) of models (n, overall) whose accuracy is low or was measured on few pixels."""
    told = F.array_compact(F.array(F.when(F.col("overall") < overall, "low accuracy"), F.when(F.col("n") < least, "few pixels")))
    return models.select(model, F.explode(told).alias("warning"))


def colours(df: DataFrame, label: str, listed: Mapping[int, str], clear: int = 255) -> DataFrame:
    """Adds red8, green8, blue8 and alpha of a class (#rrggbb); ``clear`` is see-through, unknown classes null."""
    of = F.element_at(F.create_map(*[F.lit(x) for k, v in listed.items() for x in (k, v)]), F.col(label).cast("int"))
    part = lambda at: F.conv(F.substring(of, at, 2), 16, 10).cast("int")
    seen = F.when(of.isNotNull(), F.when(F.col(label) == clear, 0).otherwise(255))
    return df.withColumns({"red8": part(2), "green8": part(4), "blue8": part(6), "alpha": seen})
