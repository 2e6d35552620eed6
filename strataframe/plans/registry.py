"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PX = """WITH px0 AS (
    SELECT event_id AS id, event_id // 100 AS r, event_id % 100 AS c, event_type, value,
           (CAST(floor((event_id // 100) / 8e0) AS BIGINT) * 3 + CAST(floor((event_id % 100) / 8e0) AS BIGINT) * 5) % 7 + 1 AS k FROM events
), px AS (
    SELECT id, r, c, k, (60 + 25 * k + (id * 7) % 41) / 1000e0 AS blue, (70 + 28 * k + (id * 11) % 43) / 1000e0 AS green,
           (80 + 30 * k + (id * 13) % 47) / 1000e0 AS red, (100 + 33 * k + (id * 17) % 53) / 1000e0 AS nir,
           (140 + 36 * k + (id * 19) % 59) / 1000e0 AS swir1, (120 + 34 * k + (id * 23) % 61) / 1000e0 AS swir2,
           1000e0 + 12 * c + 3 * r + value / 10 AS dem,
           CASE event_type WHEN 'purchase' THEN 4 WHEN 'view' THEN 5 WHEN 'click' THEN 6 WHEN 'signup' THEN 11 WHEN 'error' THEN 9 END AS scl
    FROM px0
), hw AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px),
land AS (
    SELECT *, CASE WHEN scl = 6 THEN 251 WHEN scl = 11 THEN 250
        WHEN (green - swir1) / (green + swir1 + 1e-6) > 0.4e0 AND green > 0.15e0 AND nir > 0.11e0 THEN 250
        WHEN ((green - swir1) / (green + swir1 + 1e-6) > 0.1e0 AND nir < 0.10e0) OR ((green - nir) / (green + nir + 1e-6) > 0.15e0 AND nir < 0.15e0) THEN 251
        WHEN (nir - red) / (nir + red + 1e-6) > 0.45e0 THEN 252
        WHEN (blue + green + red + nir + swir1 + swir2) / 6 < 0.035e0 THEN 253 ELSE 0 END AS lc
    FROM px
), surface AS (SELECT *, CASE WHEN lc = 0 THEN k ELSE lc END AS label, lc = 0 AND scl NOT IN (0, 1, 3, 8, 9, 10) AS usable FROM land)
"""


def reflected(index: str, size: str) -> str:
    return f"(CASE WHEN {index} < 0 THEN -({index}) - 1 WHEN {index} >= {size} THEN 2 * {size} - 1 - ({index}) ELSE {index} END)"


def around(source: str, values: str, reach: int, name: str, keys: str = "") -> str:
    """A table of aggregates over a mirrored square around each pixel."""
    return f""", {name} AS (
    SELECT t.r, t.c{keys}, {values} FROM {source} t, hw, range(-{reach}, {reach + 1}) AS a(dr), range(-{reach}, {reach + 1}) AS b(dc), {source} s
    WHERE s.r = {reflected("(t.r + dr)", "h")} AND s.c = {reflected("(t.c + dc)", "w")} GROUP BY t.r, t.c{keys}
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add
