"""Packing documents into fixed-length sequences along a Hilbert curve.

A document's hashed bag of words is projected to four dimensions; the Hilbert
key of its cell orders all documents so that similar ones lie near each other.
Documents are sorted by ranges of keys, tokenized in that order and laid end to end;
cutting that one stream every 1024 ids packs neighbours together and leaves at
most one sequence short.  Texts are shuffled once and tokenized once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, lean, limit_batches, written
from .textarrays import ASCII_LOWER, Block, find_words, range_hashes, text_blocks
from .tokens import encoder, text_slices

SEQUENCE = 1024
DIMENSIONS = 4
BITS = 13
#: Bits of a document's hash below its place on the curve, by which equal texts are spread.
TIE_BITS = 11
#: One document in so many, by hash, tells where to cut the curve into stretches.
BOUNDS_SHARE = 25
#: Bytes of text in a stretch of the curve, about, and in the stretches of one task.
STRETCH_BYTES, TASK_BYTES = 8 << 20, 32 << 20
#: Stretches for each shuffle partition at least, so that small tables are dealt evenly too.
STRETCHES = 4


def project(block: Block) -> np.ndarray:
    """Cells (rows by dimensions) of each text: sums of hashed word vectors.

    Each word's vector is four signed bytes of its hash.  The sum over n words is
    divided by sqrt(n), so that its spread doesn't depend on length, and then
    squeezed to a cell.  A text without words lies in the middle.
    """
    words = find_words(block)
    hashes = range_hashes(ASCII_LOWER[block.data], words.starts, words.ends)
    vectors = hashes.view(np.int8).reshape(len(hashes), 8)[:, :DIMENSIONS]
    sums = np.zeros((len(hashes) + 1, DIMENSIONS), np.int64)
    np.cumsum(vectors, axis=0, out=sums[1:])
    totals = (sums[words.bounds[1:]] - sums[words.bounds[:-1]]).astype(np.float64)
    scaled = totals / np.sqrt(np.maximum(words.counts, 1))[:, None] / 74.0
    unit = 1.0 / (1.0 + np.exp(-1.7 * np.clip(scaled / 4, -20, 20)))
    return np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell on the Hilbert curve (Skilling's transform, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _keys(docs: DataFrame, bounds: np.ndarray, doc: str, text: str) -> DataFrame:
    """(doc, text, key, stretch) of each row; other columns are dropped, rows are not.

    A key is the place on the curve, then a hash of the document's id: a group of
    equal texts of any size is dealt over many stretches.
    """

    @F.arrow_udf("struct<key: long, stretch: int>")
    def place(texts: pa.Array, ties: pa.Array) -> pa.Array:
        found = [hilbert_keys(project(block)) for block in text_blocks(texts)]
        keys = np.concatenate(found) if found else np.zeros(0, np.int64)
        keys = keys << TIE_BITS | ties.to_numpy(zero_copy_only=False)
        stretch = np.searchsorted(bounds, keys, side="right").astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(stretch)], ["key", "stretch"])

    tie = F.pmod(F.xxhash64(doc), F.lit(1 << TIE_BITS))
    # Only the key comes back from Python; the text stays where it is.
    return docs.select(F.col(doc), F.col(text), place(F.col(text), tie).alias("_place")).select(doc, text, "_place.key", "_place.stretch")


def curve_bounds(docs: DataFrame, stretches: int, doc: str = "doc_id", text: str = "text") -> np.ndarray:
    """Keys that cut the curve into about equal stretches.

    They only balance the work; the order of documents doesn't depend on them.
    A range shuffle would compute the keys of all texts twice to find its own.
    """
    sample = docs.filter(F.pmod(F.xxhash64(doc), F.lit(BOUNDS_SHARE)) == 0)
    keys = _keys(sample, np.zeros(0, np.int64), doc, text)
    shares = [k / stretches for k in range(1, stretches)]
    found = keys.agg(F.percentile_approx("key", shares, max(10_000, 4 * stretches)).alias("b")).first()["b"] if shares else None
    return np.unique(np.array(found or [], np.int64))


def _tokenized(ordered: DataFrame, doc: str, text: str, kind: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc, key, stretch, before, n_tokens, ids): ``before`` counts ids of the stretch so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end, current, before = encode.dtype.type(end_id).tobytes(), None, 0
        for batch in batches:
            for rows, texts in text_slices(batch, text):
                ids = [x + end for x in encode.encode(texts)]
                counts = np.array([len(x) // encode.width for x in ids], np.int64)
                starts = np.cumsum(counts) - counts
                stretches = rows.column("stretch").to_numpy(zero_copy_only=False)
                for lo, hi in zip(*_equal_runs(stretches), strict=True):
                    before = before if stretches[lo] == current else 0
                    current = stretches[lo]
                    starts[lo:hi] += before - starts[lo]
                    before = int(starts[hi - 1] + counts[hi - 1])
                columns = [rows.column(doc), rows.column("key"), rows.column("stretch"), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [doc, "key", "stretch", "before", "n_tokens", "ids"])
        give_back()  # but for the encoder, which the next task needs

    return ordered.mapInArrow(run, f"{doc} {kind}, key long, stretch int, before long, n_tokens long, ids binary")


def _equal_runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(values)]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = SEQUENCE, doc: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents and their places in sequences.

    Columns: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    ``ids`` (little-endian unsigned 32-bit) if asked for.  A null text is empty
    and so only its end id; rows that share an id or a key all stay, ordered by
    (key, doc, text hash).  A very long text is one row of one task and is cut over as
    many sequences as it needs.  An empty table gives no pieces.  Other columns,
    whatever their names, are not read.
    """
    limit_batches(docs.sparkSession)
    docs = docs.select(doc, text)
    kind = docs.schema[doc].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = max(STRETCHES * partitions, -(-size // STRETCH_BYTES))
    keyed = _keys(docs, curve_bounds(docs, stretches, doc, text), doc, text)
    # Whole stretches go to a task, which sorts them along the curve.
    tasks = max(partitions, -(-size // TASK_BYTES))
    ordered = keyed.repartition(tasks, "stretch").sortWithinPartitions("stretch", "key", doc, F.xxhash64(text))
    width = encoder(tokenizer).width
    stream = written(_tokenized(ordered, doc, text, kind, tokenizer, end_id), "packed-tokens")
    # One number for each stretch.
    totals = {r["stretch"]: r["n"] for r in stream.groupBy("stretch").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(batch.column("stretch").to_pylist(), batch.column("before").to_pylist(), batch.column("ids"), strict=True)
            picks = []
            for k, (part, before, value) in enumerate(rows):
                ids = np.frombuffer(value.as_buffer(), f"<u{width}").astype("<u4")
                at, start = base[part] + before, 0
                while start < len(ids):
                    offset = (at + start) % length
                    size = min(length - offset, len(ids) - start)
                    piece = ids[start : start + size].tobytes()
                    picks.append(k)
                    out.append((start, size, zlib.crc32(piece), len(ids), (at + start) // length, offset, piece if with_ids else None))
                    start += size
            columns = [batch.column(doc).take(pa.array(picks, pa.int64()))]
            names = [doc, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            values = list(zip(*out, strict=True)) or [()] * 7
            columns += [pa.array(v, pa.int64()) for v in values[:6]]
            if with_ids:
                columns.append(pa.array(values[6], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    schema = f"{doc} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return stream.select(doc, "stretch", "before", "ids").mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def padded_length(used: int, length: int = SEQUENCE) -> int:
    """Ids that a sequence takes: ``used`` if that is a power of two, else the full length."""
    return used if used > 0 and used & (used - 1) == 0 else length
