"""Removal of lines that many documents share, with two Bloom filters.

Each task sets the bits of its documents' line keys in a filter of what was seen
once, and in a second one where the bits were set before by another document.
Filters of tasks are merged slice by slice: what is set in two tasks' first
filters was seen twice.  So the second filter misses no key of two documents.  Only
lines that it suspects leave the second scan, as digests, for an exact count of
documents; a third scan takes the confirmed lines out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import limit_batches, written
from .textarrays import ASCII_LOWER, NOT_SPACE, Block, mix64, range_hashes, text_blocks

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bits of a filter: 2 to this power, chosen by the bytes of text.  The larger bound is 64 MB; beyond
#: it more lines are suspected by mistake, and none is missed.
LEAST_BITS, MOST_BITS = 20, 29
#: Bytes of text for each bit of a filter; bits that a key sets.
BYTES_A_BIT, PLACES = 8, 2
#: Bits of a slice, which one task merges.
SLICE_BITS = 20
#: Keys with more than this share of all suspected rows are heavy; there can't be more than its inverse.
HEAVY_SHARE = 1e-4
#: Lines to drop up to which they are broadcast to the documents; beyond it both sides shuffle.
BROADCAST_DROPS = 1_000_000
_BREAK = 10


def line_keys(block: Block, least_chars: int = LEAST_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, lower) of each line whose key is long enough; ``lower`` are the block's bytes, lower-cased."""
    data = block.data
    lower = ASCII_LOWER[data]
    solid = np.flatnonzero(NOT_SPACE[data])
    if len(solid) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, lower
    breaks = np.flatnonzero(data == _BREAK)
    begins = np.unique(np.concatenate([block.offsets[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    ends = np.minimum(np.append(begins[1:], len(data)), len(data))
    first = np.searchsorted(solid, begins)
    last = np.searchsorted(solid, ends) - 1
    some = np.flatnonzero(first <= last)
    start, end = solid[first[some]], solid[last[some]] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[end] - points[start] >= least_chars
    start, end = start[long], end[long]
    return np.searchsorted(block.offsets, start, side="right") - 1, start, end, lower


def _once_a_row(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each key of a row stands first."""
    order = np.lexsort((hashes, row))
    new = np.ones(len(row), bool)
    new[1:] = (row[order[1:]] != row[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
    return order[new]


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, one row for each of ``PLACES``."""
    return np.stack([mix64(hashes + np.uint64(k)) >> np.uint64(64 - bits) for k in range(PLACES)]).astype(np.int64)


def _add(once: np.ndarray, twice: np.ndarray, places: np.ndarray) -> None:
    """Sets bits in ``once``, and those in ``twice`` that were set before or come again."""
    used, times = np.unique(places, return_counts=True)
    for chosen, again in ((used, False), (used[times > 1], True)):
        if len(chosen):
            cell = chosen >> 3
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            masks = np.bitwise_or.reduceat(np.uint8(1) << (chosen & 7).astype(np.uint8), first)
            if again:
                twice[cell[first]] |= masks
            else:
                twice[cell[first]] |= once[cell[first]] & masks
                once[cell[first]] |= masks


def twice_seen(docs: DataFrame, doc: str, text: str, bits: int, least_chars: int = LEAST_CHARS) -> np.ndarray:
    """The filter of keys that two documents hold, in packed bits: none is missing."""
    slices = 1 << max(0, bits - SLICE_BITS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << bits >> 3, np.uint8), np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                row, start, end, lower = line_keys(block, least_chars)
                hashes = range_hashes(lower, start, end)
                _add(once, twice, _places(hashes[_once_a_row(row, hashes)], bits).ravel())
        yield _packed_slices(dict(enumerate(zip(np.split(once, slices), np.split(twice, slices), strict=True))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, *packed in zip(batch.column("slice").to_pylist(), batch.column("once"), batch.column("twice"), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8) for x in packed)
                if k in sums:
                    once, twice = sums[k]
                    twice |= b | once & a
                    once |= a
                else:
                    sums[k] = a.copy(), b.copy()
        yield _packed_slices(sums)

    schema = "slice int, once binary, twice binary"
    parts = docs.select(doc, text).mapInArrow(scan, schema).repartition(slices, "slice").mapInArrow(merge, schema)
    found = np.zeros(1 << bits >> 3, np.uint8)
    for row in parts.select("slice", "twice").collect():  # the filter's own size, at most 64 MB
        part = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        found[row.slice * len(part) : (row.slice + 1) * len(part)] = part
    return found


def _packed_slices(slices: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kept = {k: x for k, x in slices.items() if x[0].any()}
    columns = [pa.array([zlib.compress(x[i].tobytes(), 1) for x in kept.values()], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), *columns], ["slice", "once", "twice"])


def _digest(key: bytes) -> tuple[int, int]:
    found = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def suspected(docs: DataFrame, seen: np.ndarray, doc: str, text: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, doc): 128-bit digests of the keys that the filter suspects, once a row of ``docs``."""
    kind = docs.schema[doc].dataType.simpleString()
    bits = (len(seen) * 8).bit_length() - 1
    packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(seen.tobytes(), 1))
    held: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(np.frombuffer(zlib.decompress(packed.value), np.uint8))
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                row, start, end, lower = line_keys(block, least_chars)
                hashes = range_hashes(lower, start, end)
                at = _places(hashes, bits)
                maybe = np.flatnonzero(((held[0][at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0))
                if not len(maybe):
                    continue
                # One line for each key of a row, and one digest for each key of a block.
                maybe = maybe[_once_a_row(row[maybe], hashes[maybe])]
                _, one, key = np.unique(hashes[maybe], return_index=True, return_inverse=True)
                digests = np.array([_digest(lower[start[i] : end[i]].tobytes()) for i in maybe[one]], np.int64).reshape(-1, 2)[key]
                rows = batch.column(doc).take(pa.array(row[maybe] + block.lo))
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), rows], ["k1", "k2", "doc"])

    return docs.select(doc, text).mapInArrow(run, f"k1 long, k2 long, doc {kind}")


def shared_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Suspected rows (k1, k2, doc), and (k1, k2, keeper, n) of each key that enough documents hold.

    ``keeper`` is the largest id that holds the key.
    """
    limit_batches(docs.sparkSession)
    if bits is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, int(size / BYTES_A_BIT).bit_length()))
    seen = twice_seen(docs, doc, text, bits, least_chars)
    rows = written(suspected(docs, seen, doc, text, least_chars), "suspected-lines")
    # Ids of a key first fall together task by task, then count once each; so a line
    # that a third of the documents hold meets in no task.
    counts = rows.filter("doc is not null").distinct().groupBy("k1", "k2").agg(F.max("doc").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return rows, written(counts.filter(F.col("n") >= least_docs), "shared-lines")


def lines_to_drop(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc, drops): packed digests of the lines that documents lose.

    Heavy keys, whose number is bounded by their share of all rows, are broadcast;
    the others have few rows each and shuffle.
    """
    heavy = F.col("n") > F.lit(max(1000.0, rows.count() * HEAVY_SHARE))
    there = rows.filter("doc is not null").distinct()
    lost = there.join(F.broadcast(shared.filter(heavy)), ["k1", "k2"]).select("doc", "keeper", "k1", "k2")
    lost = lost.unionByName(there.join(F.broadcast(shared.filter(heavy)), ["k1", "k2"], "left_anti").join(shared.filter(~heavy), ["k1", "k2"]).select("doc", "keeper", "k1", "k2"))
    return lost.filter("doc != keeper").groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("drops"))


def clean_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int | None = None) -> DataFrame:
    """(doc, n_lines, n_dropped, kept_text) of every row of ``docs``.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased.  Keys of at least ``least_chars`` code points that at least
    ``least_docs`` documents hold lose all their lines except in the largest id that
    holds them.  A null or empty text is one empty line.  Rows that share an id are one
    document in what counts, and each loses the same keys.  Rows of a null id count for
    nothing and lose no line.  A line that comes twice in a document goes, or stays, both
    times.  A very long text is read whole, within one task.  An empty table gives an
    empty one.  Other columns, whatever their names, are not read.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                rows = batch.slice(block.lo, block.hi - block.lo)
                found = _cleaned(rows.column(text), rows.column("__sf_drops"), block, least_chars)
                yield pa.RecordBatch.from_arrays([rows.column(doc), *found], ["doc", "n_lines", "n_dropped", "kept_text"])

    out = _with_drops(docs.select(doc, text), doc, text, least_chars, least_docs, bits).mapInArrow(run, f"doc {kind}, n_lines long, n_dropped long, kept_text string")
    return out.withColumnRenamed("doc", doc)


def _with_drops(docs: DataFrame, doc: str, text: str, least_chars: int, least_docs: int, bits: int | None) -> DataFrame:
    """``docs`` and the digests of the lines that each row loses, as ``__sf_drops``."""
    rows, shared = shared_lines(docs.select(doc, text), doc, text, least_chars, least_docs, bits)
    drops = written(lines_to_drop(rows, shared), "dropped-lines")
    total = drops.agg(F.sum(F.size("drops")), F.count(F.lit(1))).first()
    if (total[0] or 0) + total[1] <= BROADCAST_DROPS:
        drops = F.broadcast(drops)
    limit_batches(docs.sparkSession)
    drops = drops.select(F.col("doc").alias("__sf_of"), F.col("drops").alias("__sf_drops"))
    return docs.join(drops, F.col(doc) == F.col("__sf_of"), "left").drop("__sf_of")


def _cleaned(texts: pa.Array, drops: pa.Array, block: Block, least_chars: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Lines, dropped lines and what is left of each text; only those that lose lines are cut up."""
    n = len(texts)
    breaks = np.flatnonzero(block.data == _BREAK)
    lines = np.diff(np.searchsorted(breaks, block.offsets)) + 1
    dropped = np.zeros(n, np.int64)
    kept = texts.cast(pa.string()).fill_null("")
    losing = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False))
    if len(losing):
        row, start, end, lower = line_keys(block, least_chars)
        bounds = np.searchsorted(row, np.arange(n + 1))
        new = kept.to_pylist()
        for i, gone in zip(losing.tolist(), drops.take(pa.array(losing)).to_pylist(), strict=True):
            gone = {(x["k1"], x["k2"]) for x in gone}
            lo, hi = block.offsets[i], block.offsets[i + 1]
            ends = np.append(breaks[(breaks >= lo) & (breaks < hi)], hi)
            keep = np.ones(len(ends), bool)
            for j in range(bounds[i], bounds[i + 1]):
                if _digest(lower[start[j] : end[j]].tobytes()) in gone:
                    keep[np.searchsorted(ends, start[j], side="right")] = False
            begins = np.append(lo, ends[:-1] + 1)
            dropped[i] = len(keep) - keep.sum()
            new[i] = b"\n".join(block.data[b:e].tobytes() for b, e in zip(begins[keep], ends[keep], strict=True)).decode()
        kept = pa.array(new, pa.string())
    return pa.array(lines), pa.array(dropped), kept


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int | None = None) -> DataFrame:
    """``docs`` with shared lines cut from ``text``; all its columns, a null text stays null.

    Rows, nulls, repeats and long texts as in ``clean_lines``; other columns may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                rows = batch.slice(block.lo, block.hi - block.lo)
                found = _cleaned(rows.column(text), rows.column("__sf_drops"), block, least_chars)[2]
                if rows.column(text).null_count:
                    found = pa.array(found.to_pylist(), found.type, mask=rows.column(text).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([found if c == text else rows.column(c) for c in names], names)

    names = docs.columns
    return _with_drops(docs, doc, text, least_chars, least_docs, bits).mapInArrow(run, docs.schema)
