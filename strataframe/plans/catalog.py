"""All registered queries and their SQL."""

from . import details, maps, raster, rasters, relations, workflow  # noqa: F401  registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
