"""Vectorised text helpers used inside Arrow tasks.

A block of documents is one flat ``uint8`` array plus byte offsets; words are
(start, end) byte ranges in it.  Everything here works on whole blocks with
numpy, so no Python code runs per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import limit_batches

#: Bytes of text at once; some forty times as much memory is in use meanwhile.
BLOCK_BYTES = 1 << 20
#: Rows at once; row numbers within a block fit into 16 bits.
BLOCK_ROWS = 1 << 15

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_COMBINE = _rng.integers(1, 1 << 63, 128, dtype=np.uint64) | np.uint64(1)
#: Longer stretches of bytes are hashed one by one.
_SUMMED_BYTES = 256
_powers: dict[str, np.ndarray] = {}

#: Lower-cases A-Z and nothing else.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: True for bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their UTF-8 bytes and byte offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Byte ranges of words; ``bounds[i]:bounds[i + 1]`` are those of row i."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole rows; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + block_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1), lo + BLOCK_ROWS)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def find_words(block: Block, is_word: np.ndarray = NOT_SPACE) -> Words:
    """Words of each row: runs of bytes for which ``is_word`` holds."""
    inside = is_word[block.data]
    size = len(inside)
    if size == 0:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(block.offsets), np.int64))
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = block.offsets[(block.offsets > 0) & (block.offsets < size)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on ``uint64``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(kind: str, base: int, size: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < size:
        size = max(size, BLOCK_BYTES + 1)
        table = np.full(size, np.uint64(base), np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[kind] = table
    return table


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal contents at any place."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = len(data)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table("up", _BASE, size)[:size], out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    raw = (sums[ends] - sums[starts]) * _power_table("down", inverse, size + 1)[starts]
    # Patterned words of a thousand letters and more could agree in such a sum.
    for i in np.flatnonzero(ends - starts > _SUMMED_BYTES):
        raw[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; ``len(hashes) - n + 1`` values."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:size] * _COMBINE[0]
    for j in range(1, n):
        total += hashes[j : j + size] * _COMBINE[j]
    return mix64(total + np.uint64(n))


def gram_starts(words: Words, n: int) -> np.ndarray:
    """Indices of words at which n consecutive words of one row begin."""
    counts = np.maximum(words.counts - n + 1, 0)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts, counts) + np.repeat(words.bounds[:-1], counts)


def sum_ranges(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bi" else values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def crc32_mod(column: str, modulus: int):
    """Spark expression: crc32 of the column as text, modulo a number."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def map_text(
    df: DataFrame,
    keys: list[str],
    text: str,
    function: Callable[[pa.RecordBatch, Block], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """Applies ``function(batch of the block's rows, block)`` to every block.

    Only ``keys`` and ``text`` are read, whatever other columns ``df`` has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                out = function(batch.slice(block.lo, block.hi - block.lo), block)
                if out.num_rows:
                    yield out

    limit_batches(df.sparkSession)
    return df.select(*keys, text).mapInArrow(run, schema)
