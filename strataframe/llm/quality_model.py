"""Quality classifier with supervised subword embeddings.

Words and character n-grams are hashed to buckets that each have a learned vector; a
document is the mean of its features' vectors, followed by a softmax over two
labels.  Training is stochastic gradient descent in numpy on a bounded sample
of labelled documents.  A trained bucket gives one number (its vector times
the difference of the output rows), so a document is scored by a mean of those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import Block, find_words, map_text, range_hashes, text_blocks

#: Labelled documents used for training at most; those of lowest hash are taken.
SAMPLE_ROWS = 3000
#: Bytes of text, over the sample, used for training at most.
SAMPLE_BYTES = 24 << 20
BUCKET_BITS = 17
DIMENSIONS = 8
EPOCHS = 6
GRAMS = (3, 4)
#: A bucket of its own for a word equal to the one before it.
_ECHO = 1 << BUCKET_BITS
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _gram_buckets(points: np.ndarray, n: int) -> np.ndarray:
    """Bucket of every n consecutive code points."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    code = np.full(size, n, np.uint64)
    for j in range(n):
        code = (code ^ points[j : j + size]) * _SPREAD  # odd, so that no point is lost before the top bits are taken
        code ^= code >> np.uint64(32)
    return ((code * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the rows' offsets in them."""
    if not (block.data & 0x80).any():
        return block.data.astype(np.uint64), block.offsets
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    before = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=before[1:])
    return points, before[block.offsets]


def features(block: Block) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, from, to) for each kind: row i has ``buckets[from[i]:to[i]]``."""
    words = find_words(block)
    hashes = range_hashes(block.data, words.starts, words.ends)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[words.bounds[:-1][words.bounds[:-1] < len(echo)]] = False
    # The pair of a word and itself has a bucket of its own.
    buckets = np.where(echo, _ECHO, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    out = [(buckets, words.bounds[:-1], words.bounds[1:])]
    points, offsets = _code_points(block)
    for n in GRAMS:
        grams = _gram_buckets(points, n)
        start = np.minimum(offsets[:-1], len(grams))
        out.append((grams, start, np.maximum(start, np.minimum(offsets[1:] - n + 1, len(grams)))))
    return out


@dataclass
class Model:
    """``weight[b]`` is what a feature in bucket b adds to the mean logit of label 1."""

    weight: np.ndarray
    bias: float

    def scores(self, block: Block) -> np.ndarray:
        total = np.zeros(len(block.offsets) - 1)
        count = np.zeros(len(total))
        for buckets, start, end in features(block):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[buckets], dtype=np.float64)])
            total += sums[end] - sums[start]
            count += end - start
        logit = total / np.maximum(count, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate.

    Without both labels the model gives the share of label 1 for every text.
    """
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for block in text_blocks(pa.array(texts, pa.large_string())):
        kinds = features(block)
        for i in range(len(block.offsets) - 1):
            ids, n = np.unique(np.concatenate([b[s[i] : e[i]] for b, s, e in kinds]), return_counts=True)
            rows.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    y = np.array(labels)
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-0.5, 0.5, (_ECHO + 1, DIMENSIONS)).astype(np.float32)
    output = rng.uniform(-0.5, 0.5, (2, DIMENSIONS)).astype(np.float32)
    bias = np.log(np.array([1 - share, share])).astype(np.float32)
    if 0 < y.sum() < len(y):
        steps, step = EPOCHS * len(rows), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                ids, part = rows[i]
                rate = 2.0 * (1 - step / steps)
                step += 1
                if len(ids) == 0:
                    continue
                mean = part @ vectors[ids]
                logit = output @ mean + bias
                p = np.exp(logit - logit.max())
                error = p / p.sum()
                error[y[i]] -= 1
                change = error @ output
                output -= 0.2 * rate * np.outer(error, mean)
                bias -= 0.02 * rate * error
                # A feature's share of a long text is tiny; the root evens the step out.
                vectors[ids] -= (rate * np.sqrt(part))[:, None] * change
    else:
        output[:] = 0
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Trains on at most ``SAMPLE_ROWS`` labelled documents and ``SAMPLE_BYTES`` of text.

    Rows with a null label or id are passed over; a null text is empty.  Labels
    of equal hash go by id and label; a label or document that is there twice
    teaches twice.  A very long text counts whole, if it is within the bytes or the first.
    Without labels the score is one half for every text.  Other columns, whatever
    their names, are not read.
    """
    # The ids are chosen from the small table of labels, so few texts move.
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(doc, F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64(doc), doc, "_label").limit(SAMPLE_ROWS)
    sample = docs.select(F.col(doc), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), doc)
    texts, y, size = [], [], 0
    for row in sample.orderBy(F.xxhash64(doc), doc, "_label").toLocalIterator():
        size += len(row["_text"].encode())
        if size > SAMPLE_BYTES and texts:
            break
        texts.append(row["_text"])
        y.append(int(row["_label"] == 1))
    return train(texts, y)


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc, score, predicted) for every row, repeated ones too.

    A null text scores like an empty one: by the share of labels alone.  A score that
    equals the threshold predicts 1.  A very long text is scored whole, within one task; an
    empty table gives an empty one.  Other columns, whatever their names, are not read.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def run(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        scores = model.scores(block)
        predicted = pa.array((scores >= threshold).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(doc), pa.array(scores), predicted], [doc, "score", "predicted"])

    return map_text(docs, [doc], text, run, f"{doc} {kind}, score double, predicted int")
