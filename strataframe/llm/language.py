"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3, a word's edge
counting as a symbol) in order of frequency, summed over all training texts.  A
text's own most frequent n-grams are compared with each profile: the distance
is the sum of how far each is out of place, with the profile's size for one
that isn't in it.  The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, limit_batches
from .textarrays import Block, text_blocks

PROFILE = 300
UNKNOWN = "und"
#: Bytes of text at once; each takes up to a hundred bytes of memory meanwhile.
BLOCK_BYTES = 1 << 19
_EDGE = 1
_GRAM_BITS = 48
#: Distinct n-grams that a task gathers before it passes them on.
_TASK_GRAMS = 1_000_000
_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Code point below 65536 to its lower-cased letter, or to the edge symbol."""
    if not _fold:
        table = np.full(1 << 16, _EDGE, np.uint64)
        for code in range(1 << 16):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else code
        _fold.append(table)
    return _fold[0]


def block_symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a block, an edge before and after each row, and rows' offsets in them."""
    codes = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
    offsets = points[block.offsets]
    symbols = np.where(codes < 1 << 16, _folding()[codes & 0xFFFF], _EDGE)
    beyond = np.flatnonzero(codes >= 1 << 16)
    if len(beyond):  # rare letters outside the basic plane keep 16 bits of their code
        symbols[beyond] = [int(c) & 0xFFFF | 0x8000 if chr(int(c)).isalpha() else _EDGE for c in codes[beyond]]
    n = len(offsets) - 1
    out = np.full(len(symbols) + n + 1, _EDGE, np.uint64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = symbols
    return out, offsets + np.arange(n + 1)


def gram_keys(symbols: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sorted ``group << 48 | n-gram`` of all n-grams without an edge inside."""
    group = np.repeat(groups.astype(np.uint64) << np.uint64(_GRAM_BITS), np.diff(offsets))
    first, second, third = symbols[:-1], symbols[1:], np.append(symbols[2:], np.uint64(_EDGE))
    # A row's own symbols begin after its leading edge, which the row before shares.
    letter1, letter2 = first != _EDGE, second != _EDGE
    pair = first << np.uint64(16) | second
    one = (group | second)[letter2]
    two = (group | pair)[letter1 | letter2]
    three = (group | pair << np.uint64(16) | third)[letter2]
    # An n-gram that begins at a row's last letter belongs to that row.
    return np.sort(np.concatenate([one, two, three]))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def block_grams(block: Block, groups: np.ndarray) -> np.ndarray:
    symbols, offsets = block_symbols(block)
    return gram_keys(symbols, offsets, groups)


@dataclass
class Profiles:
    """``ranks[i, k]``: place of the i-th of ``grams`` in the k-th language."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows whose language isn't null."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[starts], np.add.reduceat(counts, starts)

        def batch_of(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            labels = np.array(list(names), object)[(keys >> np.uint64(_GRAM_BITS)).astype(np.int64)]
            grams = (keys & np.uint64((1 << _GRAM_BITS) - 1)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            for block in text_blocks(batch.column(text), BLOCK_BYTES):
                labels = batch.column(lang).slice(block.lo, block.hi - block.lo).to_pylist()
                groups = np.array([names.setdefault(x, len(names)) for x in labels])
                found = runs(block_grams(block, groups))
                if len(found[0]):
                    held.append(found)
                    pending += len(found[0])
                if pending > _TASK_GRAMS:
                    held = [merged()]
                    pending = len(held[0][0])
                    if pending > _TASK_GRAMS // 2:
                        yield batch_of(*held[0])
                        held, pending = [], 0
        if held:
            yield batch_of(*merged())

    limit_batches(docs.sparkSession)
    counted = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias(lang), text).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of every language; all rows count, ``size`` rows per language are collected.

    Ties in frequency go by the n-gram's code.  Without training rows there is no language.
    """
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = gram_counts(docs, text, lang).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)
    rows = ranked.select("lang", "gram", "rank").collect()
    langs = sorted({r.lang for r in rows})
    grams = np.unique(np.array([r.gram for r in rows], np.uint64))
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int32)
    if rows:
        at = np.searchsorted(grams, np.array([r.gram for r in rows], np.uint64))
        ranks[at, [langs.index(r.lang) for r in rows]] = [r["rank"] - 1 for r in rows]
    return Profiles(langs, grams, ranks, size)


def distances(block: Block, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each row to each language, and the number of n-grams compared."""
    n, size = len(block.offsets) - 1, profiles.size
    keys, counts = runs(block_grams(block, np.arange(n)))
    row = (keys >> np.uint64(_GRAM_BITS)).astype(np.int64)
    order = np.argsort((row << 32) - counts, kind="stable")
    bounds = np.searchsorted(row, np.arange(n + 1))
    place = np.arange(len(keys)) - bounds[row]
    top = place < size
    place, row, gram = place[top], row[top], keys[order[top]] & np.uint64((1 << _GRAM_BITS) - 1)
    used = np.bincount(row, minlength=n)
    if len(profiles.grams) == 0:
        return np.zeros((n, 0)), used
    at = np.minimum(np.searchsorted(profiles.grams, gram), len(profiles.grams) - 1)
    at = np.where(profiles.grams[at] == gram, at, len(profiles.grams))
    out = np.zeros((n, len(profiles.langs)))
    for k in range(len(profiles.langs)):
        rank = profiles.ranks[:, k][at]
        moved = np.where(rank < 0, size, np.abs(rank - place))
        out[:, k] = np.bincount(row, weights=moved, minlength=n)
    return out, used


def predictor(profiles: Profiles) -> Callable[[Column], Column]:
    """A column function from text to ``struct<lang_pred, score, far>``; see ``identify``.

    ``far`` is the nearest distance per compared n-gram, null without any.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double, far: double>")
    def predict(texts: pa.Array) -> pa.Array:
        names: list[str] = []
        scores, each = [np.zeros(0)], [np.zeros(0)]
        for block in text_blocks(texts, BLOCK_BYTES):
            far, used = distances(block, profiles)
            n = len(used)
            if far.shape[1] == 0:
                names += [UNKNOWN] * n
                scores.append(np.zeros(n))
                each.append(np.full(n, np.nan))
                continue
            best = np.argmin(far, axis=1)
            each.append(np.where(used > 0, far.min(axis=1) / np.maximum(used, 1), np.nan))
            names += [profiles.langs[k] if u else UNKNOWN for k, u in zip(best, used, strict=True)]
            if far.shape[1] == 1:
                scores.append((used > 0).astype(float))
            else:
                two = np.partition(far, 1, axis=1)[:, :2]
                total = two.sum(axis=1)
                scores.append(np.where(used > 0, np.where(total > 0, two[:, 1] / np.maximum(total, 1), 0.5), 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(each), from_pandas=True)], ["lang_pred", "score", "far"])

    # Called so, it isn't computed again for every filter on its result.
    return predict.asNondeterministic()


def reaches(docs: DataFrame, predict: Callable[[Column], Column], share: float, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """Distance per n-gram within which a share of each language's own texts lie, of those found to be in it."""
    found = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), predict(F.col(text)).alias("_found"))
    own = found.filter(F.col("_found.lang_pred") == F.col("lang")).groupBy("lang").agg(F.percentile_approx("_found.far", share).alias("far"))
    return {r.lang: r.far for r in own.collect()}


def identify(docs: DataFrame, profiles: Profiles, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang_pred, score) for every row.

    ``und`` with score 0 if the text is null, empty or without letters, or if no
    language was learned.  ``score`` is the second nearest distance over the sum
    of the two nearest (1 if there is only one language); equal distances go
    to the first language by name.  Repeated rows are judged alike and all stay; an
    empty table gives an empty one; a very long text is counted whole, within one task.
    Other columns, whatever their names, are not read.
    """
    return docs.select(F.col(doc), predictor(profiles)(F.col(text)).alias("_found")).select(doc, "_found.lang_pred", "_found.score")
