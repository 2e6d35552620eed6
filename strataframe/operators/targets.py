"""Connected areas of a raster and the targets made from them."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .halos import TILE


def _lowest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest that each of ``n`` nodes reaches by links between ``a`` and ``b``."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _named(cells: DataFrame, width: int, label: str | None, corners: bool, cut: int | None, tile: int) -> DataFrame:
    """Adds ``node``: the lowest r * width + c that a cell reaches within its tile."""
    columns = cells.columns

    def name(table: pa.Table) -> pa.Table:
        top, left = (int(table.column(k)[0].as_py()) * tile for k in ("_tr", "_tc"))
        i, j = (table.column(k).cast(pa.int64()).to_numpy() - b for k, b in (("r", top), ("c", left)))
        # Kinds of cells: -1 is none; null (-2) is alike along a row only.
        kinds = np.full((tile, tile), -1)
        kinds[i, j] = table.column(label).combine_chunks().dictionary_encode().indices.fill_null(-2).to_numpy(zero_copy_only=False) if label else 0
        places = np.arange(tile * tile).reshape(tile, tile)
        free = [np.ones(tile, bool) if cut is None else np.arange(b + 1, b + tile + 1) % cut != 0 for b in (top, left)]
        ends = []
        for dr, dc in STEPS if corners else STEPS[:2]:
            near = np.s_[: tile - dr, max(0, -dc) : tile - max(0, dc)]
            far = np.s_[dr:, max(0, dc) : tile + min(0, dc)]
            alike = (kinds[near] == kinds[far]) & (kinds[near] > (-2 if dr else -3)) & (kinds[near] != -1)
            if dr:
                alike &= free[0][: tile - dr, None]
            if dc:
                alike &= free[1][None, : tile - 1]  # of the two columns the left one's right side
            ends.append((places[near][alike], places[far][alike]))
        low = _lowest_reached(tile * tile, *(np.concatenate(x) for x in zip(*ends, strict=True)))[places[i, j]]
        node = (top + low // tile) * width + left + low % tile
        return table.select(columns).append_column("node", pa.array(node))

    placed = cells.filter(F.col("r").isNotNull() & F.col("c").isNotNull()).withColumn("_tr", F.floor(F.col("r") / tile)).withColumn("_tc", F.floor(F.col("c") / tile))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema]
    return placed.groupBy("_tr", "_tc").applyInArrow(name, ", ".join([*fields, "node long"]))


def shared_folder(spark: SparkSession) -> str | None:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a folder of its own, others None."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local["):
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder and folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Computed once: written to the folder in ``spark.checkpoint.dir`` and read again.

    Where that is unset, a local session gets a folder of its own and another one persists.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df.persist()
    place = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


#: (rows, columns) to the cells that touch one by a side, then by a corner; each pair once.
STEPS = ((0, 1), (1, 0), (1, 1), (1, -1))


def connected(cells: DataFrame, width: int, label: str | None = None, corners: bool = True, cut: int | None = None, tile: int = TILE) -> DataFrame:
    """Adds ``component`` to cells (r, c) that touch: the lowest r * width + c.

    Cells touch by a side or, with ``corners``, by a corner, with ``label`` only where it is
    the same, and with ``cut`` not across rows and columns that it divides.  Each tile of ``tile``
    pixels is gone through in one task; then lowest labels spread over links between tiles, a
    label's own label being followed each time, until none changes.
    """
    columns = cells.columns
    named = settled(_named(cells, width, label, corners, cut, tile))
    zone = lambda r, c, size: F.struct(F.floor(r / size), F.floor(c / size))
    r, c = F.col("r"), F.col("c")
    kind = F.col(label) if label else F.lit(0)
    rim = named.filter(F.pmod(r, F.lit(tile)).isin(0, tile - 1) | F.pmod(c, F.lit(tile)).isin(0, tile - 1)).select("r", "c", "node", kind.alias("_kind"))
    links = None
    for dr, dc in STEPS if corners else STEPS[:2]:
        leaves = zone(r, c, tile) != zone(r + dr, c + dc, tile)
        if cut:
            leaves = leaves & (zone(r, c, cut) == zone(r + dr, c + dc, cut))
        moved = rim.filter(leaves).select((r + dr).alias("r"), (c + dc).alias("c"), F.col("node").alias("a"), F.col("_kind").alias("_other"))
        alike = F.col("_other") == F.col("_kind") if dr else F.col("_other").eqNullSafe(F.col("_kind"))
        met = moved.join(rim, ["r", "c"]).filter(alike).select("a", F.col("node").alias("b"))
        links = met if links is None else links.unionByName(met)
    edges = settled(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    before = None
    while True:
        spread = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(spread, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"))
        jumped = closer.join(closer.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left")
        labels = settled(jumped.select("node", F.least("label", F.coalesce("up", "label")).alias("label")))
        total = labels.agg(F.sum("label")).first()[0]
        if total == before:
            break
        before = total
    moved = labels.filter("node != label").select("node", F.col("label").alias("_to"))
    return named.join(moved, "node", "left").select(*columns, F.coalesce("_to", "node").alias("component"))


def component_statistics(cells: DataFrame, score: str, kind: str, least: int, area_ha: float = 0.04) -> DataFrame:
    """One row per component of ``least`` pixels or more: size, scores, centre, most frequent kind.

    Ties among kinds go to the lowest.
    """
    kinds = cells.groupBy("component", kind).agg(F.count(F.lit(1)).alias("_n")).groupBy("component").agg(F.min_by(kind, F.struct(-F.col("_n"), F.col(kind))).alias("kind"))
    sizes = cells.groupBy("component").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg(score).alias("mean_score"), F.max(score).alias("peak_score"), F.avg(F.col("c") + 0.5).alias("x"), F.avg(F.col("r") + 0.5).alias("y")
    ).filter(F.col("pixels") >= least)
    rank = F.col("mean_score") * F.log10(F.col("pixels") + 10)
    return sizes.join(kinds, "component").select("component", "pixels", (F.col("pixels") * area_ha).alias("area_ha"), "mean_score", "peak_score", "x", "y", "kind", rank.alias("rank_score"))


def sieve(df: DataFrame, label: str, width: int, least: int, out: str) -> DataFrame:
    """Adds the label with patches of fewer than ``least`` pixels given to their largest neighbour.

    Patches touch by sides.  Of equally large neighbours the one that begins
    first counts; a patch without neighbours keeps its label.
    """
    parts = settled(connected(df.select("r", "c", label), width, label, corners=False))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.first(label).alias("_label"))
    borders = None
    for dr, dc in ((0, 1), (1, 0)):
        moved = parts.select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col("component").alias("a"))
        met = moved.join(parts.select("r", "c", F.col("component").alias("b")), ["r", "c"]).filter("a != b").select("a", "b")
        borders = met if borders is None else borders.unionByName(met)
    both = borders.unionByName(borders.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    small = sizes.filter(F.col("n") < least).select(F.col("component").alias("a"))
    near = both.join(small, "a").join(sizes.select(F.col("component").alias("b"), F.col("n").alias("_n"), "_label"), "b")
    taken = near.groupBy("a").agg(F.max_by("_label", F.struct("_n", -F.col("b"))).alias("_to"))
    placed = parts.join(taken, F.col("component") == F.col("a"), "left").select("r", "c", F.coalesce("_to", label).alias(out))
    return df.join(placed, ["r", "c"])


def top_per_group(targets: DataFrame, group: str, n: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col("rank_score").desc(), "component")
    return targets.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


#: Targets of a group that are looked at together when some are chosen.
HEAD = 1000


def apart(targets: DataFrame, group: str, distance: float, most: int) -> DataFrame:
    """Targets in order of rank, each kept if it lies ``distance`` from all kept before it, ``most`` of a group.

    Whether a target is kept hangs only on those above it.  So the best ``HEAD`` of each
    group are gone through one by one; if these don't give ``most``, all that lie
    too near to a kept one are struck from the whole table and the best of the rest
    come next.  Only heads meet in a task, however many targets there are.
    """
    spark = targets.sparkSession
    kept = spark.createDataFrame([], targets.schema)
    rest, found = targets, {}

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank_score", "component"], ascending=[False, True]).reset_index(drop=True)
        free = np.ones(len(frame), bool)
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        chosen = []
        for i in range(len(frame)):
            if free[i] and len(chosen) < most:
                chosen.append(i)
                free &= np.hypot(x - x[i], y - y[i]) >= distance
        return frame.assign(_seen=len(frame)).iloc[chosen]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema)
    schema = f"{fields}, _seen long"
    while True:
        rows = top_per_group(rest, group, HEAD).drop("place").groupBy(group).applyInPandas(keep, schema).collect()  # at most ``most`` rows a group
        for row in rows:
            have = found.setdefault(row[group], [])
            if len(have) < most:
                have.append(row)
        open_groups = {row[group] for row in rows if row["_seen"] >= HEAD and len(found[row[group]]) < most}
        if not open_groups:
            break
        near = spark.createDataFrame([(g, r["x"], r["y"]) for g in open_groups for r in found[g]], f"_group {targets.schema[group].dataType.simpleString()}, _x double, _y double")
        close = (F.col(group) == F.col("_group")) & (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) < distance)
        rest = settled(rest.filter(F.col(group).isin(*open_groups)).join(F.broadcast(near), close, "left_anti"))  # ``most`` rows a group
    chosen = [tuple(row)[:-1] for rows in found.values() for row in rows]
    return kept.unionByName(spark.createDataFrame(chosen, targets.schema)) if chosen else kept
