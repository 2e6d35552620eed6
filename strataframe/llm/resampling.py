"""Importance resampling towards a target distribution of hashed n-grams.

Texts of a task become runs of word ids.  A suffix array of these ids, in which
neighbours are compared word by word, shows each n-gram as one run of suffixes
whose common prefix is long enough: its bucket is hashed once and dealt back to all
places of the run.  Buckets counted over all texts and all target texts give each
bucket a gain, in thousandths of a natural logarithm; a text's weight is the mean
gain of its n-grams.  Gumbel noise from a hash of the id turns the highest scores
into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import limit_batches, written
from .textarrays import ASCII_LOWER, Block, find_words, range_hashes, text_blocks

LONGEST, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text whose words share one suffix array; a longer text has one of its own.
ARRAY_BYTES = 4 << 20

#: True for bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a lower-cased text.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


@dataclass
class Features:
    """Buckets of all n-grams of a block, and the row of each."""

    rows: np.ndarray
    buckets: np.ndarray
    n_words: np.ndarray


def suffix_array(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of word ids in the order of their first ``longest`` words, and how many words
    each has in common with the one before it, at most ``longest``.

    ``left`` tells how many words a suffix has up to its row's end.
    """
    size = len(ids)
    padded = np.append(ids + 1, np.zeros(longest, np.int64))
    word = [np.where(left > k, padded[k : k + size], 0) for k in range(longest)]
    order = np.lexsort(word[::-1])
    common, same = np.zeros(size, np.int64), np.ones(max(0, size - 1), bool)
    for x in word:
        x = x[order]
        same &= (x[1:] == x[:-1]) & (x[1:] > 0)
        common[1:] += same
    return order, common


def features(block: Block, longest: int = LONGEST, buckets: int = BUCKETS) -> Features:
    """All runs of 1 to ``longest`` consecutive words of each row, as buckets."""
    lower = ASCII_LOWER[block.data]
    words = find_words(Block(block.lo, block.hi, lower, block.offsets), IS_WORD)
    counts = words.counts
    if len(words.starts) == 0:
        none = np.zeros(0, np.int64)
        return Features(none, none, counts)
    _, first, ids = np.unique(range_hashes(lower, words.starts, words.ends), return_index=True, return_inverse=True)
    known = [lower[s:e].tobytes() for s, e in zip(words.starts[first], words.ends[first], strict=True)]
    after = [b" " + x for x in known]
    row = words.rows
    left = words.bounds[1:][row] - np.arange(len(ids))
    order, common = suffix_array(ids, left, longest)
    rows, found = [], []
    code = np.zeros(len(ids), np.int64)  # of the run of the n-gram one word shorter, by suffix
    for n in range(1, longest + 1):
        # A run of suffixes that have n words in common is one n-gram.
        new = np.flatnonzero((common < n) & (left[order] >= n))
        if len(new) == 0:
            break
        heads = order[new]
        last = ids[heads + n - 1]
        if n == 1:
            crc = [zlib.crc32(known[w]) for w in last.tolist()]
        else:
            crc = [zlib.crc32(after[w], c) for w, c in zip(last.tolist(), code[heads].tolist(), strict=True)]
        long = left[order] >= n
        run = np.cumsum((common < n) & long) - 1
        places = order[long]
        code[places] = np.array(crc, np.int64)[run[long]]
        rows.append(row[places])
        found.append(code[places] % buckets)
    return Features(np.concatenate(rows), np.concatenate(found), counts)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in text_blocks(batch.column(0), ARRAY_BYTES):
                total += np.bincount(features(block, longest, buckets).buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    limit_batches(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    for row in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 * ln) of its smoothed share in the target against that in the raw texts."""
    buckets, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (float(s) + buckets) / ((float(a) + 1) * (float(t) + buckets)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc, n_words, n_features, weight): the floored mean gain of each text's n-grams, 0 without any."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(text), ARRAY_BYTES):
                found, n = features(block, longest, len(gain)), block.hi - block.lo
                count = np.bincount(found.rows, minlength=n)
                total = np.zeros(n, np.int64)
                order = np.argsort(found.rows, kind="stable")
                sums = np.append(0, np.cumsum(gain[found.buckets[order]]))
                ends = np.cumsum(count)
                total = sums[ends] - sums[ends - count]
                columns = [batch.column(doc).slice(block.lo, n), pa.array(found.n_words), pa.array(count), pa.array(total // np.maximum(count, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_features", "weight"])

    limit_batches(docs.sparkSession)
    return docs.select(doc, text).mapInArrow(run, f"doc {kind}, n_words long, n_features long, weight long")


def noise(doc: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256 of ``seed:id``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, draws: int, order: list[Column]) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, ... of the ``draws`` eligible rows of highest ``score``; others have null.

    Scores are whole numbers of a bounded range, so a table of how many rows have each
    tells where its ranks begin; only rows of one score are ordered with each other.
    """
    levels = scored.filter("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    begins = levels.select(F.col("score").alias("__sf_level"), F.coalesce(ahead, F.lit(0)).cast("long").alias("__sf_ahead")).filter(F.col("__sf_ahead") < draws)
    # A score is bounded by its gains and its noise, so this table is too.
    there = scored.join(F.broadcast(begins), F.col("eligible") & (F.col("score") == F.col("__sf_level")), "left")
    drawn = there.filter("__sf_ahead is not null").withColumn("rank", F.col("__sf_ahead") + F.row_number().over(Window.partitionBy("score").orderBy(*order)))
    rank = F.when(F.col("rank") <= draws, F.col("rank")).cast("long")
    rest = there.filter("__sf_ahead is null").withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", rank).unionByName(rest).drop("__sf_level", "__sf_ahead")


def resample(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank) of every row of ``docs``.

    ``rank`` numbers the drawn rows: of those with ``least_words`` words the ``percent``
    hundredths of highest score, ties to the smaller id.  Null and empty texts have no words,
    on either side, and a weight of 0; without any target text the gains still are
    defined.  A null id has the noise of an empty one and comes last in ties.  Rows that
    share an id are drawn each for itself, with the same noise.  An empty table gives
    an empty one.  A very long text has a suffix array of its own, within one task.  Other
    columns, whatever their names, are not read.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    found = weights(docs, gain, doc, text, longest)
    scored = found.withColumn("score", F.col("weight") + noise(F.col("doc"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    scored = written(scored, "resampling-scores")
    draws = scored.filter("eligible").count() * percent // 100
    out = ranked(scored, draws, [F.col("doc").asc_nulls_last(), F.col("n_features"), F.col("n_words")])
    return out.select(F.col("doc").alias(doc), "n_words", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose id is drawn by ``resample``.

    Rows that share a drawn id all stay; a null id never does.
    """
    ids = resample(docs, target, doc, text, **parameters).filter("rank is not null").select(F.col(doc).alias("__sf_drawn")).distinct()
    return docs.join(ids, F.col(doc) == F.col("__sf_drawn"), "left_semi")
