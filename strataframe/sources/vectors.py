"""Occurrences, vector features and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lookup


def _first_named(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of several possible columns that isn't blank, by name without case."""
    found = {c.strip().lower(): c for c in df.columns}
    picked = [F.nullif(F.trim(F.col(f"`{found[n]}`").cast("string")), F.lit("")) for n in names if n in found]
    return F.coalesce(*picked) if picked else F.lit(None).cast("string")


def model_key(name: Column, plural: bool) -> Column:
    """A name as it is looked up: trimmed, lower case, and without its final s if ``plural``."""
    key = F.lower(F.trim(name))
    return F.rtrim(key, F.lit("s")) if plural else key


def occurrences(df: DataFrame, models: dict[str, str], kind: str = "gem", plural: bool = True) -> DataFrame:
    """(lat, lon, kind, model, name) of a table whose headers vary; rows without coordinates are left out."""
    lat = _first_named(df, ("lat", "latitude", "y")).try_cast("double")
    lon = _first_named(df, ("lon", "lng", "longitude", "x")).try_cast("double")
    name = _first_named(df, ("name", "locality", "site"))
    what = _first_named(df, (kind, "mineral", "type"))
    return df.select(lat.alias("lat"), lon.alias("lon"), what.alias(kind), lookup(model_key(what, plural), models).alias("model"), name.alias("name")).filter("lat is not null and lon is not null")


def out_of_range(df: DataFrame) -> DataFrame:
    """Rows whose coordinates no place on earth has."""
    return df.filter(~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(ord, geom_type, coordinates as JSON text, properties) of a feature collection."""
    text = spark.read.text(path, wholetext=True)
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    features = text.select(F.posexplode(F.from_json("value", schema)["features"]).alias("ord", "f"))
    return features.select("ord", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def polygons(features: DataFrame) -> DataFrame:
    """(ord, rings, properties): one row per polygon, those of multipolygons apart."""
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("geom_type") == "Polygon", F.array(one)).when(F.col("geom_type") == "MultiPolygon", many)
    return features.select("ord", F.explode(rings).alias("rings"), "properties")


def points(features: DataFrame) -> DataFrame:
    at = F.from_json("coordinates", "array<double>")
    return features.filter("geom_type = 'Point'").select("ord", at[0].alias("lon"), at[1].alias("lat"), "properties")


def unit_classes(units: Column, by_name: dict[str, int], short: dict[str, int]) -> Column:
    """Class of a map unit by its full name, its short name, or its number."""
    number = units.try_cast("int")
    return F.coalesce(lookup(F.lower(F.trim(units)), {k.lower(): v for k, v in by_name.items()}), lookup(F.lower(F.trim(units)), {k.lower(): v for k, v in short.items()}), F.when(number.between(1, 7), number))
