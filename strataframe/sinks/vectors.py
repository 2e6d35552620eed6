"""GeoJSON, CSV and GeoPackage writers, and well-known binary."""

from __future__ import annotations

import contextlib
import itertools
import sqlite3
import struct
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(lon: Column, lat: Column, properties: list[str]) -> Column:
    """A GeoJSON point feature as JSON text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"))
    values = F.struct(*properties) if properties else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), values.alias("properties")))


def write_features(df: DataFrame, folder: str, lon: str = "lon", lat: str = "lat") -> None:
    """One JSON feature a line, in as many files as there are tasks."""
    properties = [c for c in df.columns if c not in (lon, lat)]
    df.select(feature(F.col(lon), F.col(lat), properties).alias("value")).write.mode("overwrite").text(folder)


def read_features(spark, folder: str, properties: str) -> DataFrame:
    schema = f"geometry struct<type: string, coordinates: array<double>>, properties struct<{properties}>"
    rows = spark.read.text(folder).select(F.from_json("value", schema).alias("f"))
    return rows.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def line_feature(coordinates: Column, properties: list[str]) -> Column:
    """A GeoJSON line feature from an array of (x, y) arrays, as JSON text."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(coordinates, lambda p: F.transform(p, lambda v: F.round(v, 6))).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def polygon_feature(rings: Column, properties: list[str]) -> Column:
    """A GeoJSON polygon feature from rings, the outer one first, as JSON text."""
    rounded = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, 6))))
    geometry = F.struct(F.lit("Polygon").alias("type"), rounded.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_polygons(df: DataFrame, folder: str, rings: str = "rings") -> None:
    """One JSON polygon feature a line, in as many files as there are tasks; other columns are its properties."""
    properties = [c for c in df.columns if c != rings]
    df.select(polygon_feature(F.col(rings), properties).alias("value")).write.mode("overwrite").text(folder)


def _wkb_points(points: list) -> bytes:
    return struct.pack(f"<I{2 * len(points)}d", len(points), *(float(v) for p in points for v in p[:2]))


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def line_wkb(points: list) -> bytes:
    return struct.pack("<BI", 1, 2) + _wkb_points(points)


def polygon_wkb(rings: list) -> bytes:
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(_wkb_points, rings))


def multi_wkb(kind: int, parts: list[bytes]) -> bytes:
    """A collection of kind 4 (points), 5 (lines) or 6 (polygons)."""
    return struct.pack("<BII", 1, kind, len(parts)) + b"".join(parts)


def gpkg_geometry(wkb: bytes, box: tuple[float, float, float, float], srs: int) -> bytes:
    """Well-known binary behind a GeoPackage header with its bounds (least and greatest x, then y)."""
    return b"GP" + struct.pack("<BBi4d", 0, 3, srs, box[0], box[2], box[1], box[3]) + wkb


# What the GeoPackage standard demands of a file.
_APPLICATION, _VERSION = 0x47504B47, 10300
_WGS84 = (
    'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],'
    'PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4326"]]'
)
_SYSTEMS = (("Undefined cartesian SRS", -1, "NONE", -1, "undefined"), ("Undefined geographic SRS", 0, "NONE", 0, "undefined"), ("WGS 84 geodetic", 4326, "EPSG", 4326, _WGS84))
_STANDARD = {
    "gpkg_spatial_ref_sys": "srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT",
    "gpkg_contents": "table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id)",
    "gpkg_geometry_columns": "table_name TEXT NOT NULL PRIMARY KEY REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL",
}
_KINDS = {"int": "INTEGER", "bigint": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "DOUBLE"}
#: Rows that go into the file at once.
_INSERT = 2000


@dataclass(frozen=True)
class Layer:
    """Rows of one kind of geometry: POINT (an array x, y), LINESTRING (of points) or POLYGON (of rings)."""

    rows: DataFrame
    kind: str
    geometry: str = "geometry"

    def encode(self, shape: list) -> tuple[bytes, list]:
        """Well-known binary and all points."""
        if self.kind == "POINT":
            return point_wkb(*shape[:2]), [shape]
        if self.kind == "LINESTRING":
            return line_wkb(shape), shape
        return polygon_wkb(shape), [p for ring in shape for p in ring]


class _File:
    """A GeoPackage being written."""

    def __init__(self, db: sqlite3.Connection, srs: int):
        self.db, self.srs = db, srs
        db.execute(f"PRAGMA application_id = {_APPLICATION}")
        db.execute(f"PRAGMA user_version = {_VERSION}")
        for name, columns in _STANDARD.items():
            db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", _SYSTEMS)

    def add(self, name: str, layer: Layer) -> None:
        others = {f.name: _KINDS.get(f.dataType.simpleString(), "TEXT") for f in layer.rows.schema if f.name != layer.geometry}
        declared = ["fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL", f"geom {layer.kind}", *(f'"{c}" {t}' for c, t in others.items())]
        self.db.execute(f'CREATE TABLE "{name}" ({", ".join(declared)})')
        bounds = None
        insert = f'INSERT INTO "{name}" VALUES (NULL{", ?" * (len(others) + 1)})'
        rows = layer.rows.filter(F.col(layer.geometry).isNotNull()).toLocalIterator(prefetchPartitions=True)
        while some := list(itertools.islice(rows, _INSERT)):
            held = []
            for row in some:
                wkb, points = layer.encode(row[layer.geometry])
                xs, ys = [p[0] for p in points], [p[1] for p in points]
                box = (min(xs), min(ys), max(xs), max(ys))
                bounds = box if bounds is None else (*map(min, bounds[:2], box[:2]), *map(max, bounds[2:], box[2:]))
                held.append([gpkg_geometry(wkb, box, self.srs), *(v if t != "TEXT" or v is None else str(v) for t, v in ((t, row[c]) for c, t in others.items()))])
            self.db.executemany(insert, held)
        contents = "INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)"
        self.db.execute(contents, [name, name, *(bounds or [None] * 4), self.srs])
        self.db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", [name, layer.kind, self.srs])


def write_geopackage(path: str, layers: dict[str, Layer], srs: int = 4326) -> None:
    """A single-file GeoPackage of layers of points, lines and polygons.

    The format is one SQLite file, so rows pass through the driver, partition by
    partition; it is for target lists and the like, not for rasters.
    """
    Path(path).unlink(missing_ok=True)
    with contextlib.closing(sqlite3.connect(path)) as db, db:
        out = _File(db, srs)
        for name, layer in layers.items():
            out.add(name, layer)


def write_points_geopackage(path: str, layers: dict[str, DataFrame], lon: str = "lon", lat: str = "lat", srs: int = 4326) -> None:
    """A GeoPackage of points given by two columns."""
    placed = {name: Layer(df.withColumn("_at", F.array(F.col(lon).cast("double"), F.col(lat).cast("double"))).drop(lon, lat), "POINT", "_at") for name, df in layers.items()}
    write_geopackage(path, placed, srs)
