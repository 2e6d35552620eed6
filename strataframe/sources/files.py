"""What the raster sources share: files by any address, and the window that filters leave."""

from __future__ import annotations

from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

#: Sources get filters only where a session allows it.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Window:
    """Rows and columns, both ends included, that filters on ``r`` and ``c`` leave."""

    def __init__(self) -> None:
        self.low = {"r": 0, "c": 0}
        self.high = {"r": 1 << 62, "c": 1 << 62}

    def narrow(self, filters: Iterable[Filter]) -> None:
        """Takes in comparisons with whole numbers; others change nothing."""
        for f in filters:
            axis = getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            if len(axis) != 1 or axis[0] not in self.low or not isinstance(value, int) or isinstance(value, bool):
                continue
            least, most = {
                EqualTo: (value, value), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None),
                LessThan: (None, value - 1), LessThanOrEqual: (None, value),
            }.get(type(f), (None, None))
            if least is not None:
                self.low[axis[0]] = max(self.low[axis[0]], least)
            if most is not None:
                self.high[axis[0]] = min(self.high[axis[0]], most)

    def meets(self, axis: str, first: int, last: int) -> bool:
        """Whether any of the lines first to last, both included, is wanted."""
        return last >= self.low[axis] and first <= self.high[axis]
