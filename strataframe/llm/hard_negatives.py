"""Hard negatives by a search over candidates bucketed by norm.

Vectors of whole numbers are sorted by norm and packed into buckets of neighbours.
A task goes through its buckets from long vectors to short ones.  By Cauchy and
Schwarz no score in a bucket exceeds the anchor's norm times the bucket's largest,
so a bucket is left out for anchors whose k-th best score so far, or whose windows'
lower limits, lie above that.  Anchors come in blocks of bounded size, each against
all buckets; a task keeps a few rows per anchor, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import limit_batches, new_folder, written

POSITIVES, NEGATIVES, PERCENT = 5, 3, (50, 95)
#: Every so many ids there is an anchor.
ANCHOR_EVERY = 50
#: Rows of a bucket; anchors that go to all tasks at once; anchors that meet a bucket at once.
BUCKET_ROWS, ANCHORS_AT_ONCE, ROWS_AT_ONCE = 2048, 32_768, 512
_PACKED = "bucket string, top double, ids binary, labels binary, matrix binary"
_LEAST = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, row_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(scale * x)."""
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    there = rows.filter(F.col(row_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return there.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(numbers, lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the matrix of a batch of vectors; shorter ones end in zeros."""
    lists = batch.column("v")
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(offsets)
    matrix = np.zeros((batch.num_rows, width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return batch.column("id").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False), matrix


def norm_buckets(vectors: DataFrame, width: int) -> DataFrame:
    """Buckets of ``BUCKET_ROWS`` vectors next to each other by norm; of equal rows one stays."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ordered = vectors.withColumn("norm2", length).repartitionByRange(F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id", "label", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, BUCKET_ROWS):
                ids, labels, matrix = _unpacked(batch.slice(lo, BUCKET_ROWS), width)
                whole = np.column_stack([ids, labels, matrix])
                above = np.vstack([whole[:1] - 1 if before is None else before, whole[:-1]])
                new = (whole != above).any(axis=1)
                before = whole[-1:]
                if new.any():
                    at = np.flatnonzero(new)
                    at = at[np.argsort(ids[at], kind="stable")]
                    top = float(np.sqrt((matrix[at].astype(float) ** 2).sum(axis=1).max()))
                    small = np.abs(matrix[at]).max(initial=0) < 1 << 15
                    rows = matrix[at].astype("<i2" if small else "<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{number}"]), pa.array([top]), *(pa.array([x], pa.binary()) for x in (ids[at].tobytes(), labels[at].tobytes(), rows))], ["bucket", "top", "ids", "labels", "matrix"])
                    number += 1

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = ordered.select("id", "label", "v").mapInArrow(pack, _PACKED)
    # Each task gets buckets of all norms, so that its k-th best scores soon are high.
    return packed.repartition(tasks, "bucket").sortWithinPartitions(F.desc("top"), "bucket")


def _buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
            kind = "<i8" if width and len(row["matrix"]) == 8 * width * len(ids) else "<i2"
            yield row["top"], ids, labels, np.frombuffer(row["matrix"], kind).reshape(len(ids), width)


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles as long as ``bound`` fits their 53 bits."""
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise OverflowError("scores of these vectors don't fit into 64 bits")


class _Best:
    """The k best (score, id) for each of so many places, higher scores first, then lower ids."""

    def __init__(self, places: int, k: int):
        self.k = k
        self.score = np.full((places, k), _LEAST)
        self.id = np.zeros((places, k), np.int64)

    def limit(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in what a bucket has for places ``at``; ``ids`` ascend, and ``scores`` is used up."""
        hit = np.flatnonzero(scores.max(axis=1, initial=_LEAST) > _LEAST)
        if len(hit) == 0:
            return
        at, scores, line = at[hit], scores[hit], np.arange(len(hit))
        all_scores, all_ids = [self.score[at]], [self.id[at]]
        for _ in range(min(self.k, scores.shape[1])):
            first = scores.argmax(axis=1)
            all_scores.append(scores[line, first][:, None])
            all_ids.append(ids[first][:, None])
            scores[line, first] = _LEAST
        found, names = np.hstack(all_scores), np.hstack(all_ids)
        order = np.lexsort((names, -np.maximum(found, _LEAST + 1)), axis=1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(found, order, 1), np.take_along_axis(names, order, 1)


def _table(rows: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, matrix and norms of a block of anchors."""
    matrix = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        matrix[i, : len(row.v)] = row.v
    ids, labels = (np.array([row[c] for row in rows], np.int64) for c in ("id", "label"))
    return ids, labels, matrix, np.sqrt((matrix.astype(float) ** 2).sum(axis=1))


def _pieces(chosen: np.ndarray) -> list[np.ndarray]:
    return [chosen[k : k + ROWS_AT_ONCE] for k in range(0, len(chosen), ROWS_AT_ONCE)]


def positives(buckets: DataFrame, anchors, width: int, k: int = POSITIVES) -> DataFrame:
    """(place, score, id): the k best other rows of the same label for each anchor of a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix, norms = anchors.value
        best = _Best(len(ids), k)
        for top, own, kinds, rows in _buckets(batches, width):
            bound = norms * top
            for label in np.unique(kinds):
                there = np.flatnonzero(kinds == label)
                for at in _pieces(np.flatnonzero((labels == label) & (bound * (1 + 1e-9) + 1 >= best.limit()))):
                    scores = _scores(matrix[at], rows[there], bound[at].max())
                    scores[own[there] == ids[at][:, None]] = _LEAST
                    best.add(at, scores, own[there])
        place, n = np.nonzero(best.score > _LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(best.score[place, n]), pa.array(best.id[place, n])], ["place", "score", "id"])

    return _first(buckets.mapInArrow(run, "place long, score long, id long"), "place", k)


def negatives(buckets: DataFrame, anchors, windows, width: int, k: int = NEGATIVES) -> DataFrame:
    """(window, score, id): the k best rows of other labels with a score within each window.

    ``windows`` is a broadcast of (place, lowest, highest) of each window, ordered by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, matrix, norms = anchors.value
        place, lowest, highest = windows.value
        best = _Best(len(place), k)
        for top, own, kinds, rows in _buckets(batches, width):
            bound = norms * top
            open_ = np.flatnonzero(bound[place] * (1 + 1e-9) + 1 >= np.maximum(lowest, best.limit()))
            for at in _pieces(np.unique(place[open_])):
                scores = _scores(matrix[at], rows, bound[at].max())
                scores[labels[at][:, None] == kinds] = _LEAST
                mine = open_[np.searchsorted(place[open_], at[0]) : np.searchsorted(place[open_], at[-1], side="right")]
                line = np.searchsorted(at, place[mine])
                for part in np.array_split(np.arange(len(mine)), max(1, len(mine) // ROWS_AT_ONCE)):
                    found = scores[line[part]]
                    low = np.maximum(lowest[mine[part]], best.limit()[mine[part]])
                    found[(found < low[:, None]) | (found > highest[mine[part]][:, None])] = _LEAST
                    best.add(mine[part], found, own)
        window, n = np.nonzero(best.score > _LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(best.score[window, n]), pa.array(best.id[window, n])], ["window", "score", "id"])

    return _first(buckets.mapInArrow(run, "window long, score long, id long"), "window", k)


def _first(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each key, numbered from 1; each task has sent k rows of it at most."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    row_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    every: int = ANCHOR_EVERY,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    percent: tuple[int, int] = PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``every``; their positives the best other rows of
    the same label; for each, the best rows of other labels whose score lies between the two
    hundredths of the positive's.  Ties go to the smaller id.  Rows with a null id, label or
    vector, or a null or non-finite component, take no part; a shorter vector ends in zeros,
    an empty one is all zeros.  Rows equal in id, label and vector are one; rows that
    share only an id are rows of their own, but none is the positive of another.  Without
    rows, positives or negatives there are no results.  Other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    limit_batches(spark)
    vectors = whole_vectors(rows.select(row_id, label, vector), row_id, label, vector, scale)
    width = max(0, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    buckets = written(norm_buckets(vectors, width), "norm-buckets")
    chosen = vectors.filter(F.col("id") % every == 0).distinct()
    total = chosen.count()
    blocks = -(-total * 2 // ANCHORS_AT_ONCE) if total > ANCHORS_AT_ONCE else 1
    chosen = written(chosen.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks))), "anchors")
    folder = new_folder(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in range(blocks):
        # A block is half of ANCHORS_AT_ONCE on average; so many vectors and windows go to all tasks.
        anchors = _table(chosen.filter(F.col("block") == block).select("id", "label", "v").collect(), width)
        if len(anchors[0]) == 0:
            continue
        sent = spark.sparkContext.broadcast(anchors)
        near = sorted(positives(buckets, sent, width, n_positives).select("place", "score", "id").collect(), key=lambda x: (x.place, -x.score, x.id))
        place, score, ids = (np.array([x[c] for x in near], np.int64) for c in ("place", "score", "id"))
        # percent[0] * score <= 100 * s <= percent[1] * score, for whole s.
        windows = place, -(-percent[0] * score // 100), percent[1] * score // 100
        found = negatives(buckets, sent, spark.sparkContext.broadcast(windows), width, n_negatives)
        known = spark.createDataFrame(pa.table([pa.array(np.arange(len(place))), pa.array(anchors[0][place]), pa.array(ids), pa.array(score)], ["window", "anchor_id", "positive_id", "positive_score"]))
        out = found.join(F.broadcast(known), "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
