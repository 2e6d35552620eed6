"""Map coordinates: UTM, MGRS squares, Web Mercator tiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the letters of MGRS.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
_ROWS = "ABCDEFGHJKLMNPQRSTUV"
_BANDS = "CDEFGHJKLMNPQRSTUVWXX"
MERCATOR = math.pi * _A

_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*rows: tuple[float, ...]) -> tuple[float, ...]:
    """Values of polynomials in the third flattening; the k-th begins with its k-th power."""
    return tuple(sum(c * _N ** (k + j) for j, c in enumerate(row)) for k, row in enumerate(rows, 1))


# The Krueger series of the transverse Mercator projection to the sixth order.
_ALPHA = _series(
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
_BETA = _series(
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
_DELTA = _series(
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series, to a millimetre within a zone."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _RADIUS * east, F.when(lat < 0, 1e7).otherwise(0.0) + _K0 * _RADIUS * north


def from_utm(easting: Column, northing: Column, zone: Column, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude."""
    xi0, eta0 = (northing - (1e7 if south else 0.0)) / (_K0 * _RADIUS), (easting - 500000) / (_K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def metres_of(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``to_utm`` for arrays of one zone, whose northings count from the equator or from its southern origin."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return 500000 + _K0 * _RADIUS * east, (1e7 if south else 0.0) + _K0 * _RADIUS * north


def degrees_of(easting: np.ndarray, northing: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``from_utm`` for arrays."""
    xi0, eta0 = (northing - (1e7 if south else 0.0)) / (_K0 * _RADIUS), (easting - 500000) / (_K0 * _RADIUS)
    xi = xi0 - sum(b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0) for j, b in enumerate(_BETA, 1))
    eta = eta0 - sum(b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0) for j, b in enumerate(_BETA, 1))
    chi = np.arcsin(np.sin(xi) / np.cosh(eta))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return zone * 6 - 183 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(lat)


def mgrs_square(zone: Column, easting: Column, northing: Column, lat: Column) -> Column:
    """Name of the 100 km square (northern hemisphere)."""
    column = F.lit("")
    for k, letters in enumerate(_COLUMNS):
        column = F.when((zone - 1) % 3 == k, F.substring(F.lit(letters), F.floor(easting / 100000).cast("int"), F.lit(1))).otherwise(column)
    row = F.substring(F.lit(_ROWS), (F.floor(northing / 100000) + F.when(zone % 2 == 0, 5).otherwise(0)).cast("int") % 20 + 1, F.lit(1))
    band = F.substring(F.lit(_BANDS), F.floor((lat + 80) / 8).cast("int") + 1, F.lit(1))
    return F.concat(F.lpad(zone.cast("string"), 2, "0"), band, column, row)


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(left, bottom, right, top) of an XYZ tile in Web Mercator metres."""
    size = 2 * MERCATOR / F.pow(F.lit(2.0), z)
    left, top = x * size - MERCATOR, MERCATOR - y * size
    return left, top - size, left + size, top


def tile_latitude(bottom: Column, top: Column) -> Column:
    return F.degrees(F.atan(F.sinh((top + bottom) / 2 / MERCATOR * math.pi)))
