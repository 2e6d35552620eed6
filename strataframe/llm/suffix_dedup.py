"""Removal of passages that repeat across documents, with sparse suffix arrays.

Of all suffixes only those at minimisers are kept: in each window of 50 words the
lowest hash of 25 words, the anchor, marks a position, so equal passages mark equal
places.  A kept suffix stands for the windows that chose it.  Those whose anchor
occurs once go.  Those that agree in all that their windows cover repeat as a whole.
The others are sorted by the words that follow the anchor; each is compared with its
neighbours word by word, and the match is extended to the right as far as the common
prefix reaches and to the left as far as the words before the anchor agree.  Only
the group of an anchor that more than ``HOT_ROWS`` different suffixes share is not
sorted in one task: its windows are grouped by two fingerprints instead.

A word is repeated if it lies in a window of 50 words that a document of lower id
holds too.  This is exact, whatever the number of copies: each task sorts its
own suffixes first and sends on one document of each run of equal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SMALL_BATCH_BYTES, lean, limit_batches, written
from .textarrays import Block, Words, find_words, gram_hashes, gram_starts, mix64, range_hashes, text_blocks

PASSAGE = 50
ANCHOR = 25
#: Bytes of text at once; some forty times as much memory is in use meanwhile, in each task.
BLOCK_BYTES = 1 << 19
#: Document ids up to which they are broadcast to the texts; beyond it both sides shuffle.
BROADCAST_IDS = 2_000_000
_BASE = 0xD1342543DE82EF95
#: Different suffixes of one anchor that are sorted in one task; more go by their windows.
HOT_ROWS = 20_000
#: Suffixes that go to the JVM at once.
BATCH_ROWS = 1 << 15
#: Suffixes that a task compares at once.
ROWS_AT_ONCE = 40_000
_SIDE = PASSAGE - ANCHOR
_DOCS, _SUFFIXES, _MARKS = 0, 1, 2
_SCHEMA = "kind int, doc long, anchor long, content long, start int, size int, lead int"


def _prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    powers = np.full(n + 1, np.uint64(_BASE), np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers[:n], out=sums[1:])
    inverse = np.full(n + 1, np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    return sums, np.multiply.accumulate(inverse)


def stretch_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of words, equal for equal words at any place."""
    sums, inverse = _prefix_sums(hashes)
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lowest_within(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the lowest of each ``width`` consecutive values, the first of equal ones."""
    size = len(values) - width + 1
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = at[:size], at[width - span : width - span + size]
    return np.where(values[right] < values[left], right, left)


def suffixes(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, content, start, windows, lead) of each kept suffix of a block.

    ``start`` is the first word, within its row, of the first window that chose
    the position, which lies ``lead`` words on; ``content`` tells apart what all
    its windows cover.
    """
    starts = gram_starts(words, PASSAGE)
    if len(starts) == 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    grams = gram_hashes(hashes, ANCHOR)
    chosen = lowest_within(grams, PASSAGE - ANCHOR + 1)[starts]
    rows = words.rows[starts]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])]))
    windows = np.diff(np.append(new, len(starts)))
    first, row = starts[new], rows[new]
    content = stretch_hashes(hashes, first, first + windows - 1 + PASSAGE)
    lead = chosen[new] - first
    content = mix64(content + lead.astype(np.uint64))
    return row, grams[chosen[new]], content, first - words.bounds[row], windows, lead


def _batch(kind: int, doc: np.ndarray, anchor, content, start, size, lead=None) -> pa.RecordBatch:
    def column(values, type_):
        return pa.nulls(len(doc), type_) if values is None else pa.array(values, type_)

    columns = [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc, pa.int64()), column(anchor, pa.int64()), column(content, pa.int64()), column(start, pa.int32()), column(size, pa.int32()), column(lead, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "doc", "anchor", "content", "start", "size", "lead"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, as the JVM takes each one whole."""
    for lo in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(lo, BATCH_ROWS)


def _ids(batch: pa.RecordBatch, block: Block) -> np.ndarray:
    return batch.column(1).slice(block.lo, block.hi - block.lo).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _scan(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows of ``_SCHEMA``: words of each document, kept suffixes, and marks found within a task."""

    def sorted_out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc_ids, anchor, content, start, windows, lead = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc_ids, content, anchor))
        doc_ids, anchor, content, start, windows, lead = (x[order] for x in (doc_ids, anchor, content, start, windows, lead))
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
        lowest = doc_ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        again = doc_ids > lowest
        yield from _slices(_batch(_MARKS, doc_ids[again], None, None, start[again], windows[again] - 1 + PASSAGE))
        kept = ~again
        yield from _slices(_batch(_SUFFIXES, doc_ids[kept], anchor[kept].view(np.int64), content[kept].view(np.int64), start[kept], windows[kept], lead[kept]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        pending = 0
        for batch in batches:
            for block in text_blocks(batch.column(0), BLOCK_BYTES):
                ids, words = _ids(batch, block), find_words(block)
                yield _batch(_DOCS, ids, None, None, None, words.counts)
                row, *rest = suffixes(words, range_hashes(block.data, words.starts, words.ends))
                if len(row):
                    held.append((ids[row], *rest))
                    pending += len(row)
                if pending > 1_500_000:
                    yield from sorted_out(held)
                    held, pending = [], 0
        if held:
            yield from sorted_out(held)

    return docs.filter(F.col(doc).isNotNull()).select(text, F.col(doc).cast("long").alias("_doc")).mapInArrow(run, _SCHEMA)


@dataclass
class _Parts:
    """Kept suffixes of a block's rows: their rows, anchors, first windows, windows and leads."""

    row: np.ndarray
    anchor: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lead: np.ndarray


def _of_parts(docs: DataFrame, parts: DataFrame, doc: str, text: str, make: Callable, schema: str) -> DataFrame:
    """``make(words, hashes, doc ids of rows, parts)`` for blocks of the texts that have ``parts``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0), BLOCK_BYTES):
                words = find_words(block)
                hashes = range_hashes(block.data, words.starts, words.ends)
                lists = batch.column(2).slice(block.lo, block.hi - block.lo)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                fields = [lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
                found = _Parts(row, fields[0].view(np.uint64), *fields[1:])
                # Rows that share an id may be shorter, or have other words there.
                fits = words.bounds[row] + found.start + found.size - 1 + PASSAGE <= words.bounds[row + 1]
                grams = gram_hashes(hashes, ANCHOR)
                place = words.bounds[row] + found.start + found.lead
                fits[fits] = grams[place[fits]] == found.anchor[fits]
                found = _Parts(*(x[fits] for x in (found.row, found.anchor, found.start, found.size, found.lead)))
                if len(found.row):
                    yield make(words, hashes, _ids(batch, block), found)

    lists = parts.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "size", "lead")).alias("parts"))
    texts = _only(docs.select(text, F.col(doc).cast("long").alias("_doc")), parts.select("doc"), "_doc")
    return texts.join(lists, texts["_doc"] == lists["doc"]).select(text, "_doc", "parts").mapInArrow(run, schema)


def _windows(words: Words, hashes: np.ndarray, ids: np.ndarray, parts: _Parts) -> pa.RecordBatch:
    """(window, other, doc, start): two fingerprints of every window of the suffixes."""
    inside = np.arange(parts.size.sum()) - np.repeat(np.cumsum(parts.size) - parts.size, parts.size)
    row, start = np.repeat(parts.row, parts.size), np.repeat(parts.start, parts.size) + inside
    first = words.bounds[row] + start
    found = [stretch_hashes(x, first, first + PASSAGE).view(np.int64) for x in (hashes, mix64(hashes ^ np.uint64(_BASE)))]
    return pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(ids[row]), pa.array(start, pa.int32())], ["window", "other", "doc", "start"])


def _sides(words: Words, hashes: np.ndarray, ids: np.ndarray, parts: _Parts) -> pa.RecordBatch:
    """(anchor, right, left, doc, start, size, lead): the words after each anchor and, backwards,
    those before it, as 64-bit codes; no code where the text has ended."""
    place = words.bounds[parts.row] + parts.start + parts.lead
    sides = []
    for at in (place[:, None] + ANCHOR + np.arange(_SIDE), place[:, None] - 1 - np.arange(_SIDE)):
        inside = (at >= words.bounds[parts.row][:, None]) & (at < words.bounds[parts.row + 1][:, None])
        codes = np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(0)).astype(">u8")
        sides.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * _SIDE), len(place), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary()))
    numbers = [pa.array(x, pa.int32()) for x in (parts.start, parts.size, parts.lead)]
    return pa.RecordBatch.from_arrays([pa.array(parts.anchor.view(np.int64)), *sides, pa.array(ids[parts.row]), *numbers], ["anchor", "right", "left", "doc", "start", "size", "lead"])


def _common(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Codes in which each row begins like the row before it; -1 where the key is another."""
    out = np.full(len(keys), -1)
    if len(keys) > 1:
        same = codes[1:] == codes[:-1]
        length = np.where(same.all(axis=1), codes.shape[1], np.argmin(same, axis=1))
        out[1:] = np.where(keys[1:] == keys[:-1], length, -1)
    return out


def extended(anchor: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray, size: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, last window) of suffixes that hold windows of a lower document.

    Rows are sorted by (anchor, right); ``right`` and ``left`` are codes of the words
    after and, backwards, before the anchor.  A window that begins o words before the
    anchor is that of another suffix if both go on alike for o words to the left and for
    the rest of the window to the right: if no shorter common prefix lies between
    them in either order.
    """
    n = len(anchor)
    to_right = _common(anchor, right)
    order = np.lexsort(tuple(left.T[::-1]) + (anchor,))
    to_left = _common(anchor[order], left[order])
    first, last = np.full(n, PASSAGE), np.full(n, -1)
    for o in range(_SIDE + 1):
        rows = np.flatnonzero((o <= lead) & (o > lead - size))
        if len(rows) < 2:
            continue
        run = np.cumsum(to_right < _SIDE - o)
        back = np.empty(n, np.int64)
        back[order] = np.cumsum(to_left < o)
        key = run[rows] * np.int64(n + 1) + back[rows]
        ranked = rows[np.lexsort((doc[rows], key))]
        keys = run[ranked] * np.int64(n + 1) + back[ranked]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        lowest = doc[ranked[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        hit = ranked[doc[ranked] > lowest]
        first[hit] = np.minimum(first[hit], lead[hit] - o)
        last[hit] = np.maximum(last[hit], lead[hit] - o)
    found = np.flatnonzero(last >= 0)
    return found, first[found], last[found]


def neighbour_marks(sides: DataFrame) -> DataFrame:
    """(doc, start, end) of what suffixes share with a lower document's, by sorting them."""

    def judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        anchor, doc, start, size, lead = (table.column(c).to_numpy() for c in ("anchor", "doc", "start", "size", "lead"))
        right, left = (np.frombuffer(b"".join(table.column(c).to_pylist()), ">u8").reshape(-1, _SIDE).astype(np.uint64) for c in ("right", "left"))
        rows, first, last = extended(anchor, right, left, doc, size.astype(np.int64), lead.astype(np.int64))
        begin = start[rows] + first
        return pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(begin, pa.int32()), pa.array(start[rows] + last + PASSAGE, pa.int32())], ["doc", "start", "end"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if size >= ROWS_AT_ONCE and batch.num_rows:
                # All but the last anchor, which may go on.
                anchors = [x.column("anchor").to_numpy() for x in held]
                flat = np.concatenate(anchors)
                cut = int(np.flatnonzero(flat != flat[-1])[-1]) + 1 if (flat != flat[-1]).any() else 0
                if cut:
                    table = pa.Table.from_batches(held)
                    yield judged(table.slice(0, cut).to_batches())
                    held = table.slice(cut).to_batches()
                    size -= cut
            held.append(batch)
            size += batch.num_rows
        if size:
            yield judged(held)

    ordered = sides.repartition("anchor").sortWithinPartitions("anchor", "right")
    return ordered.mapInArrow(run, "doc long, start int, end int")


def _only(docs: DataFrame, ids: DataFrame, doc: str, how: str = "left_semi") -> DataFrame:
    """Rows whose id is among ``ids`` (or isn't), by a broadcast if these are few."""
    ids = ids.select(F.col("doc").alias("__sf_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(doc) == F.col("__sf_id"), how)


def repeated_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc, n_words) of all documents, (doc, spans, n_repeated) of those with repeats).

    ``spans`` are ranges (start, end) of words, apart and in order.  Documents
    are integers; a row with a null id takes no part.  Rows that share an id
    count as one document, so they don't repeat each other.  A null or empty text has
    no words; a very long one is cut into suffixes like any other, within one
    task.  An empty table gives two empty ones.  Other columns, whatever their names,
    are not read.
    """
    limit_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    docs = docs.select(doc, text)
    scanned = written(_scan(docs, doc, text), "suffixes")
    suffix = scanned.filter(F.col("kind") == _SUFFIXES).select("anchor", "content", "doc", "start", "size", "lead")
    # Sums first, joined back from a table of their own, so that a hot anchor can be dealt over tasks.
    shared = suffix.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).filter("n > 1")
    shared = written(shared.select("anchor", (F.col("low") < F.col("high")).alias("differ")), "suffix-anchors")
    met = written(suffix.join(shared, "anchor"), "suffix-groups")
    lowest = written(met.groupBy("anchor", "content").agg(F.min("doc").alias("lowest"), F.max("doc").alias("highest")).filter("lowest < highest").drop("highest"), "suffix-lowest")
    joined = met.join(lowest, ["anchor", "content"], "left")
    again = F.coalesce(F.col("doc") > F.col("lowest"), F.lit(False))
    judged = written(joined.filter(again | F.col("differ")).select("anchor", "doc", "start", "size", "lead", again.alias("again")), "suffix-neighbours")
    whole = judged.filter("again").select("doc", "start", (F.col("start") + F.col("size") - 1 + PASSAGE).alias("end"))
    apart = judged.filter("not again").drop("again")
    hot = written(apart.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).select("anchor"), "hot-anchors")
    parts = None
    if not hot.isEmpty():
        windows = written(_of_parts(docs, apart.join(hot, "anchor", "left_semi"), doc, text, _windows, "window long, other long, doc long, start int"), "suffix-windows")
        lows = windows.groupBy("window", "other").agg(F.min("doc").alias("lowest"), F.max("doc").alias("highest")).filter("lowest < highest")
        lows = written(lows.drop("highest"), "window-lowest")
        parts = windows.join(lows, ["window", "other"]).filter("doc > lowest").select("doc", "start", (F.col("start") + PASSAGE).alias("end"))
        apart = apart.join(hot, "anchor", "left_anti")
    sides = _of_parts(docs, apart, doc, text, _sides, "anchor long, right binary, left binary, doc long, start int, size int, lead int")
    near = written(neighbour_marks(sides), "suffix-matches")
    parts = near if parts is None else near.unionByName(parts)
    local = scanned.filter(F.col("kind") == _MARKS).select("doc", "start", (F.col("start") + F.col("size")).alias("end"))
    marks = local.unionByName(whole).unionByName(parts)
    by_doc = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = marks.withColumn("opens", (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int")).withColumn("island", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_repeated"))
    words = scanned.filter(F.col("kind") == _DOCS).select("doc", F.col("size").cast("long").alias("n_words"))
    return words, spans


def cut_words(texts: pa.Array, spans: pa.Array) -> list[str]:
    """Each text without the words of its spans and the white space after them."""
    out = []
    for block in text_blocks(texts, BLOCK_BYTES):
        words = find_words(block)
        for i in range(block.hi - block.lo):
            lo, end = int(words.bounds[i]), int(block.offsets[i + 1])
            raw, at, kept = block.data, int(block.offsets[i]), []
            for span in spans[block.lo + i].as_py():
                kept.append(raw[at : words.starts[lo + span["start"]]].tobytes())
                last = lo + span["end"]
                at = int(words.starts[last]) if last < words.bounds[i + 1] else end
            kept.append(raw[at:end].tobytes())
            out.append(b"".join(kept).decode("utf-8"))
    return out


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated words cut out of ``text``; all rows and columns stay.

    The document of lowest id keeps a passage.  Other texts stay byte for byte, null
    and empty ones and those of a null id among them; rows that share an id are each
    cut at the spans of that id.  An empty table stays empty.
    """
    _, spans = repeated_spans(docs, doc, text)
    spans = written(spans, "repeated-spans")
    others = [c for c in docs.columns if c != text]
    keyed = docs.withColumn("__sf_doc", F.col(doc).cast("long"))
    rest = _only(keyed, spans.select("doc"), "__sf_doc", "left_anti").select(*docs.columns)
    hit = _only(keyed, spans.select("doc"), "__sf_doc").join(spans.select(F.col("doc").alias("__sf_hit"), F.col("spans").alias("__sf_spans")), F.col("__sf_doc") == F.col("__sf_hit"))
    hit = hit.select(*docs.columns, "__sf_spans")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = pa.array(cut_words(batch.column(text), batch.column("__sf_spans")), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), cleaned], [*others, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others, text).schema)
    return rest.unionByName(hit.mapInArrow(run, schema).select(*docs.columns))
