"""Scenes of a composite chosen as they come, with running coverage, until a tile has enough.

A scene is a row (tile, turn, granule, item, granules, clear, snow, cells): its place in the order of
its tile, counted from 0 without gaps; the number of scenes of each granule of the tile; its clear cells
as (word, bits), sixty-four cells a word, null if it couldn't be read; whether it shows snow; the
number of the tile's cells that count.  ``in_turns`` and ``clear_words`` make these columns.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Scenes of a tile to choose from, coverage that is enough, scenes that a tile and a granule
#: have at least, tries after which a granule isn't waited for, tries for each scene of a granule's quota.
MOST_ITEMS, ENOUGH, LEAST, TRIES, TRIES_A_SCENE = 6, 0.995, 2, 3, 3
CHOSEN = "tile {0}, turn long, granule string, item long, covered double"
_ROWS = ("turn", "granule", "item", "granules", "clear", "snow", "cells")


def in_turns(scenes: DataFrame, rank: list) -> DataFrame:
    """Adds ``turn`` and ``granules``: scenes of a tile by turns of its granules, the best of each first.

    ``rank`` orders a tile's scenes without ties; granules take turns in the order of their best scenes.
    """
    tile = Window.partitionBy("tile")
    placed = scenes.withColumns({"_rank": F.row_number().over(tile.orderBy(*rank)), "_place": F.row_number().over(Window.partitionBy("tile", "granule").orderBy(*rank))})
    first = placed.withColumn("_first", F.min("_rank").over(Window.partitionBy("tile", "granule")))
    turned = first.withColumn("turn", (F.row_number().over(tile.orderBy("_place", "_first")) - 1).cast("long"))
    sizes = scenes.groupBy("tile", "granule").agg(F.count(F.lit(1)).alias("n")).groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("granule", "n"))).alias("granules"))
    return turned.join(sizes, "tile").drop("_rank", "_place", "_first")


def clear_words(cells: DataFrame) -> DataFrame:
    """(tile, item, clear) from rows (tile, item, cell) of clear cells, numbered from 0 within a tile."""
    bit = F.expr("shiftleft(1L, CAST(cell % 64 AS INT))")
    words = cells.groupBy("tile", "item", F.floor(F.col("cell") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("tile", "item").agg(F.collect_list(F.struct("word", "bits")).alias("clear"))


class Choice:
    """What is known of a tile after some scenes: how often granules were used and tried, and covered cells."""

    def __init__(self, most: int = MOST_ITEMS, enough: float = ENOUGH):
        self.most, self.enough = most, enough
        self.used: dict[str, int] = {}
        self.tried: dict[str, int] = {}
        self.covered = np.zeros(0, np.uint64)
        self.taken, self.next, self.stopped = 0, 0, False

    def share(self, cells: int) -> float:
        return int(np.bitwise_count(self.covered).sum()) / max(1, cells)

    def take(self, granule: str, granules: dict, clear, snow: bool, cells: int) -> float | None:
        """Coverage after the scene is taken; None if it isn't.  Scenes come in the order of their turns."""
        self.next += 1
        quota = max(LEAST, min(self.most, math.ceil(3 * self.most / max(1, len(granules)))))
        used, tried = self.used.get(granule, 0), self.tried.get(granule, 0)
        if self.stopped or used >= quota or tried >= quota * TRIES_A_SCENE:
            return None
        served = all(self.used.get(g, 0) >= min(LEAST, n) or self.tried.get(g, 0) >= TRIES for g, n in granules.items())
        if served and self.taken >= LEAST and self.share(cells) >= self.enough:
            self.stopped = True
            return None
        self.tried[granule] = tried + 1
        if clear is None:
            return None
        if not len(clear) and not snow:  # the granule doesn't reach the tile
            self.tried[granule] += self.most
            return None
        if len(clear):
            at = np.array([w["word"] for w in clear])
            if (grown := int(at.max()) + 1 - len(self.covered)) > 0:
                self.covered = np.concatenate([self.covered, np.zeros(grown, np.uint64)])
            self.covered[at] |= np.array([w["bits"] for w in clear], np.int64).view(np.uint64)
        self.used[granule] = used + 1
        self.taken += 1
        return self.share(cells)


def _plain(row) -> tuple:
    """A scene as plain values, whatever pandas made of maps, structs and nulls."""
    turn, granule, item, granules, clear, snow, cells = row
    granules = {str(g): int(n) for g, n in (granules.items() if hasattr(granules, "items") else granules)}
    words = None if clear is None or isinstance(clear, float) else [{"word": int(w["word"]), "bits": int(w["bits"])} for w in clear]
    return int(turn), str(granule), int(item), granules, words, bool(snow) and snow == snow, int(cells)


def _out(key, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key, *row) for row in found], columns=["tile", "turn", "granule", "item", "covered"])


def choose(scenes: DataFrame, most: int = MOST_ITEMS, enough: float = ENOUGH) -> DataFrame:
    """(tile, turn, granule, item, covered) of chosen scenes, from all scenes at once; a tile is one group."""

    def walk(key, frame):
        choice, found = Choice(most, enough), []
        for row in frame.sort_values("turn")[list(_ROWS)].itertuples(index=False):
            turn, granule, item, *rest = _plain(row)
            if (covered := choice.take(granule, *rest)) is not None:
                found.append((turn, granule, item, covered))
        return _out(key[0], found)

    schema = CHOSEN.format(scenes.schema["tile"].dataType.simpleString())
    return scenes.select("tile", *_ROWS).groupBy("tile").applyInPandas(walk, schema)


class _Chooser(StatefulProcessor):
    """Keeps a tile's choice; scenes that come before their turn wait in the state until the gap is filled."""

    def __init__(self, most: int, enough: float):
        self.most, self.enough = most, enough

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("choice", "state binary")
        self.waiting = handle.getMapState("waiting", "turn long", "scene binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        choice = pickle.loads(self.known.get()[0]) if self.known.exists() else Choice(self.most, self.enough)
        come = {}
        for frame in rows:
            for row in frame[list(_ROWS)].itertuples(index=False):
                scene = _plain(row)
                if scene[0] >= choice.next and not choice.stopped:  # one sent again counts once
                    come[scene[0]] = scene
        found = []
        while not choice.stopped:
            turn = choice.next
            if turn in come:
                scene = come.pop(turn)
            elif self.waiting.containsKey((turn,)):
                scene = pickle.loads(self.waiting.getValue((turn,))[0])
            else:
                break
            if self.waiting.containsKey((turn,)):
                self.waiting.removeKey((turn,))
            _, granule, item, *rest = scene
            if (covered := choice.take(granule, *rest)) is not None:
                found.append((turn, granule, item, covered))
        if choice.stopped:
            self.waiting.clear()
        else:
            for turn, scene in come.items():
                self.waiting.updateValue((turn,), (pickle.dumps(scene),))
        self.known.update((pickle.dumps(choice),))
        yield _out(key[0], found)

    def close(self) -> None:
        pass


def choose_stream(scenes: DataFrame, most: int = MOST_ITEMS, enough: float = ENOUGH) -> DataFrame:
    """As ``choose``, from a stream of scenes in any order; a tile that has enough takes no more.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    schema = CHOSEN.format(scenes.schema["tile"].dataType.simpleString())
    return scenes.select("tile", *_ROWS).groupBy("tile").transformWithStateInPandas(_Chooser(most, enough), schema, "Append", "None")
