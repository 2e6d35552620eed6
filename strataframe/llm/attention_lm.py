"""Language-model scores from causal self-attention over subword ids, in numpy.

A word's subword ids are the longest pieces of a public byte-level vocabulary
that it begins and ends with; the most frequent pieces have a number of their own
in the model and the others share some.  One attention layer reads both numbers
of the words so far and gives a distribution over the number of the next word's
first piece, its class; the word itself then has its share of the class by counts
over all training texts::

    P(word | before) = P(class | before) * (c + 1) / (N_class + V_class + 1)

so known words and one unseen word of each class sum to one.  A class is told in
two steps, its group and its place in the group, so that no step has more than
32 outcomes.  Texts are scored in windows of 32 words that overlap by 8: each
word is scored once, with at least 8 words before it where there are so many.

Counting, training and scoring cover all texts.  The layer starts out as the
frequencies of classes and is trained by Adam in rounds, each training document in
one of them: each task trains on its own, then the weights are averaged.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, limit_batches, written
from .textarrays import ASCII_LOWER, Block, Words, find_words, range_hashes, text_blocks

#: Classes of words; a class is ``group * MEMBERS + place in the group``.  Class 0 is the end of a text.
CLASSES, GROUPS, MEMBERS = 1024, 32, 32
#: Classes that the rarer pieces share, by their id.
SHARED_CLASSES = 64
#: Bytes of the longest piece that words are told by.
PIECE_BYTES = 8
WIDTH = 16
CONTEXT = 32
STRIDE = 24
#: Rounds of training between which weights are averaged; each document is in one, by hash.
ROUNDS = 3
#: A task with few texts goes over them again until it has made so many steps.
#: Longer ones are learned in stretches of so many, so that memory doesn't grow with the task.
MIN_STEPS = 60
STEP_WINDOWS = 128
RATE = 0.01
#: Sums of weights that are added up before the last sum.
MERGERS = 32
#: Words whose counts are held in each task; all others are joined.
HELD_WORDS = 400_000
#: Hash and pieces of the end of a text.
END_HASH, END_PIECE = -1, -1
_LN10 = np.log(10.0)
_SPREADS = np.random.Generator(np.random.PCG64(5)).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SHAPES = {
    "first": (CLASSES, WIDTH), "last": (CLASSES, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
    "mix": (WIDTH, WIDTH), "distance": (CONTEXT,), "told": (GROUPS, WIDTH), "out_group": (WIDTH, GROUPS), "out_place": (WIDTH, MEMBERS),
    "bias_group": (1, GROUPS), "bias_place": (GROUPS, MEMBERS),
}
_SIZE = sum(int(np.prod(x)) for x in _SHAPES.values())
_pieces: dict[str, "Pieces"] = kept()


class Pieces:
    """The short pieces of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # Byte-level vocabularies write the bytes that print as themselves and the others from U+0100 on.
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in printed} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printed))}
        found: dict[bytes, int] = {bytes([b]): 0 for b in range(256)}
        for piece, number in vocabulary.items():
            if all(c in letters for c in piece):
                raw = bytes(letters[c] for c in piece).removeprefix(b" ")
                if 0 < len(raw) <= PIECE_BYTES and raw == raw.lower():
                    found[raw] = min(number, found.get(raw) or number)
        self.size = max(vocabulary.values(), default=0) + 1
        codes = np.array([int.from_bytes(x, "big") for x in found], np.uint64)
        lengths, ids = np.array([len(x) for x in found]), np.array(list(found.values()), np.int32)
        # Tables of slots for each length; pieces whose slot is taken go to a further, smaller one.
        self.tables: list[list[tuple]] = []
        for n in range(1, PIECE_BYTES + 1):
            own, numbers, levels = codes[lengths == n], ids[lengths == n], []
            while len(own):
                bits = (8 * len(own)).bit_length()
                spread, shift = _SPREADS[len(levels)], np.uint64(64 - bits)
                slot, taken = np.unique(((own * spread) >> shift).astype(np.int64), return_index=True)
                table, number = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, np.int32)
                table[slot], number[slot] = own[taken], numbers[taken]
                levels.append((spread, shift, table, number))
                own, numbers = np.delete(own, taken), np.delete(numbers, taken)
            self.tables.append(levels)

    def longest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: bool) -> np.ndarray:
        """Id of the longest piece at the start, or at the end, of each stretch of bytes."""
        size = ends - starts
        out = np.zeros(len(starts), np.int32)
        code = np.zeros(len(starts), np.uint64)
        rest = np.arange(len(starts))
        for n in range(1, PIECE_BYTES + 1):
            long_enough = size[rest] >= n
            rest, code = rest[long_enough], code[long_enough]
            if last:
                code = code | data[ends[rest] - n].astype(np.uint64) << np.uint64(8 * n - 8)
            else:
                code = code << np.uint64(8) | data[starts[rest] + n - 1].astype(np.uint64)
            for spread, shift, table, number in self.tables[n - 1]:
                slot = (code * spread) >> shift
                known = np.flatnonzero(table[slot] == code)
                out[rest[known]] = number[slot[known]]
        return out


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


@dataclass
class Coded:
    """Words of a block: their hashes, and the ids of the pieces that they begin and end with."""

    words: Words
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray


def code_block(block: Block, vocabulary: str) -> Coded:
    words = find_words(block)
    data = ASCII_LOWER[block.data]
    hashes = range_hashes(data, words.starts, words.ends).view(np.int64)
    hashes = np.where(hashes == END_HASH, 0, hashes)
    # Each distinct word is looked up once.
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    pieces, starts, ends = pieces_of(vocabulary), words.starts[one], words.ends[one]
    return Coded(words, hashes, pieces.longest(data, starts, ends, False)[back], pieces.longest(data, starts, ends, True)[back])


def word_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """(hash, first, last, n) of all words, ends of texts included."""

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        hashes, first, last, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return hashes[new], first[order[new]], last[order[new]], np.add.reduceat(counts[order], new)

    def batch_of(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(hashes), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["hash", "first", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        pending = ends = 0
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                coded = code_block(block, vocabulary)
                ends += block.hi - block.lo
                if len(coded.hashes):
                    held.append(merged([(coded.hashes, coded.first, coded.last, np.ones(len(coded.hashes), np.int64))]))
                    pending += len(held[-1][0])
                if pending > 2_000_000:
                    held = [merged(held)]
                    pending = len(held[0][0])
                    if pending > 1_000_000:
                        yield batch_of(*held[0])
                        held, pending = [], 0
        if held:
            yield batch_of(*merged(held))
        if ends:
            yield batch_of(np.array([END_HASH]), np.array([END_PIECE]), np.array([END_PIECE]), np.array([ends]))

    rows = docs.select(text).mapInArrow(run, "hash long, first int, last int, n long")
    return rows.groupBy("hash").agg(F.min("first").alias("first"), F.min("last").alias("last"), F.sum("n").alias("n"))


@dataclass
class Counts:
    """Totals, classes of pieces, totals of each class, and the counts of the most frequent words."""

    total: int
    distinct: int
    class_of: np.ndarray
    last_class_of: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    least: int


def _classes(counted: DataFrame, column: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each piece, and tokens and distinct words of each class."""
    rows = counted.filter(F.col(column) != END_PIECE).groupBy(column).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    piece, n, v = (rows[c].to_numpy() for c in (column, "n", "v"))
    own = CLASSES - 1 - SHARED_CLASSES
    class_of = CLASSES - SHARED_CLASSES + np.arange(size) % SHARED_CLASSES
    order = np.lexsort((piece, -n))[:own]
    class_of[piece[order]] = 1 + np.arange(len(order))
    return class_of, *(np.bincount(class_of[piece], weights=x, minlength=CLASSES).astype(np.int64) for x in (n, v))


def summarise(counted: DataFrame, size: int) -> Counts:
    """Collects one row per piece that occurs and at most ``HELD_WORDS`` words."""
    class_of, total, distinct = _classes(counted, "first", size)
    last_class_of = _classes(counted, "last", size)[0]
    # Few words have high counts: the lowest count that can be held, from how many words
    # have about each; levels are a hundredth of their count wide.
    level = F.floor(F.log2("n") * 64).alias("level")
    levels = counted.groupBy(level).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("n")).collect()
    least, held = 1 << 62, 0
    for row in sorted(levels, key=lambda r: -r.level):
        if held + row.v > HELD_WORDS:
            break
        least, held = row.n, held + row.v
    top = counted.filter((F.col("n") >= least) | (F.col("hash") == END_HASH)).select("hash", "n").toArrow()
    hashes, counts = top["hash"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(hashes)
    ends = int(counts[hashes == END_HASH].sum())
    total[0], distinct[0] = ends, int(ends > 0)
    return Counts(int(total.sum()), int(distinct.sum()), class_of, last_class_of, total, distinct, hashes[order], counts[order], least)


def initial(counts: Counts, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights that predict each class's group and place by their frequency, whatever came before."""
    rng = np.random.Generator(np.random.PCG64(seed))
    weights = {k: rng.normal(0, 0.3, shape).astype(np.float32) for k, shape in _SHAPES.items()}
    weights["told"] *= np.float32(0.1)
    weights["out_group"][:], weights["out_place"][:] = 0, 0
    weights["distance"] = (-0.1 * np.arange(CONTEXT)).astype(np.float32)
    places = counts.class_total.reshape(GROUPS, MEMBERS)
    for name, n in (("bias_group", places.sum(axis=1)[None]), ("bias_place", places)):
        weights[name] = np.log((n + 1) / (n.sum(axis=1, keepdims=True) + n.shape[1])).astype(np.float32)
    return weights


@dataclass
class Windows:
    """Inputs and targets of a block's positions, and the windows over them; the last
    ``scored`` places of a window are those it predicts."""

    first: np.ndarray
    last: np.ndarray
    target: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    unseen: np.ndarray
    scored: int


def lay_out(coded: Coded, counts: Counts, scored: int) -> Windows:
    """A text of n words has n + 1 positions: each reads what came before and is to tell the next."""
    n = len(coded.words.bounds) - 1
    bounds = coded.words.bounds + np.arange(n + 1)
    size = int(bounds[-1])
    at = np.arange(len(coded.hashes)) + coded.words.rows
    first, last, target = (np.zeros(size, np.int32) for _ in range(3))
    target[at] = counts.class_of[coded.first]
    first[at + 1], last[at + 1] = target[at], counts.last_class_of[coded.last]
    per_row = -(-np.diff(bounds) // scored)
    row = np.repeat(np.arange(n), per_row)
    begins = bounds[row] + scored * (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row))
    keys = begins[:, None] + np.arange(scored - CONTEXT, scored)[None, :]
    unseen = (keys < bounds[row][:, None]) | (keys >= bounds[row + 1][:, None])
    return Windows(first, last, target, bounds, np.clip(keys, 0, max(0, size - 1)).astype(np.int32), unseen, scored)


@functools.cache
def _reach(scored: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each scored place of a window to each place, and which lie ahead."""
    gap = (np.arange(scored) + CONTEXT - scored)[:, None] - np.arange(CONTEXT)[None, :]
    return np.clip(gap, 0, CONTEXT - 1), gap < 0


def _weights_of(p: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns logits into weights of outcomes, in place; their sums and the log probability of one outcome each."""
    np.clip(p, -60, 60, out=p)  # far beyond what training reaches; float32 holds exp(60)
    chosen = p[np.arange(len(p)), outcome]
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], p.dtype)
    return total, chosen - np.log(total)


def forward(weights: dict[str, np.ndarray], laid: Windows, picked: slice | np.ndarray, keep: bool = False):
    """Log probabilities (windows by scored places) of the targets; places that are none give 0."""
    keys, unseen, lead = laid.keys[picked], laid.unseen[picked], CONTEXT - laid.scored
    x = weights["first"][laid.first[keys]]
    x += weights["last"][laid.last[keys]]
    own = np.ascontiguousarray(x[:, lead:])
    times = lambda a, name: (a.reshape(-1, WIDTH) @ weights[name]).reshape(a.shape)
    q, k, v = times(own, "query"), times(x, "key"), times(x, "value")
    q *= np.float32(WIDTH**-0.5)
    gap, ahead = _reach(laid.scored)
    score = q @ k.transpose(0, 2, 1)
    score += np.where(ahead, np.float32(-1e4), weights["distance"][gap])
    hidden = np.flatnonzero(unseen[:, 0])  # places after the end of a text lie ahead of all that count
    score[hidden] += np.where(unseen[hidden], np.float32(-1e4), np.float32(0))[:, None, :]
    np.minimum(score, 60, out=score)
    np.exp(score, out=score)
    score /= (score.reshape(-1, CONTEXT) @ np.ones(CONTEXT, score.dtype)).reshape(len(keys), laid.scored, 1) + np.float32(1e-30)
    seen = score @ v
    h = own + times(seen, "mix")
    h = h.reshape(-1, WIDTH)
    target = laid.target[keys[:, lead:]].ravel()
    group, place = target // MEMBERS, target % MEMBERS
    p1 = h @ weights["out_group"]
    p1 += weights["bias_group"]
    h2 = h + weights["told"][group]
    p2 = h2 @ weights["out_place"]
    p2 += weights["bias_place"][group]
    (total1, log1), (total2, log2) = _weights_of(p1, group), _weights_of(p2, place)
    logs = log1 + log2
    real = ~unseen[:, lead:]
    logp = np.where(real, logs.reshape(real.shape), np.float32(0))
    return (logp, real, keys, x, own, q, k, v, score, seen, h, h2, group, place, p1, p2, total1, total2) if keep else logp


def _add_rows(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each id."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    ranked = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[ranked[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def gradients(weights: dict[str, np.ndarray], laid: Windows, picked: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log probability over some windows."""
    _, real, keys, x, own, q, k, v, score, seen, h, h2, group, place, p1, p2, total1, total2 = forward(weights, laid, picked, keep=True)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    share = (real.ravel() / max(1, real.sum())).astype(np.float32)
    at = np.arange(len(group))
    for p, total, outcome in ((p1, total1, group), (p2, total2, place)):
        p *= (share / total)[:, None]
        p[at, outcome] -= share
    g = {"out_group": h.T @ p1, "bias_group": p1.sum(0, keepdims=True), "out_place": h2.T @ p2, "bias_place": _add_rows(group, p2, GROUPS)}
    back = p2 @ weights["out_place"].T
    g["told"] = _add_rows(group, back, GROUPS)
    back += p1 @ weights["out_group"].T
    dh = back.reshape(own.shape)
    g["mix"] = flat(seen).T @ back
    dseen = (back @ weights["mix"].T).reshape(own.shape)
    dv = score.transpose(0, 2, 1) @ dseen
    dscore = dseen @ v.transpose(0, 2, 1)
    dscore -= (dseen * seen).sum(axis=2, keepdims=True)
    dscore *= score
    gap, ahead = _reach(laid.scored)
    g["distance"] = np.bincount(gap[~ahead], weights=dscore.sum(0)[~ahead], minlength=CONTEXT).astype(np.float32)
    dq, dk = dscore @ k, dscore.transpose(0, 2, 1) @ q
    dq *= np.float32(WIDTH**-0.5)
    g["query"], g["key"], g["value"] = flat(own).T @ flat(dq), flat(x).T @ flat(dk), flat(x).T @ flat(dv)
    dx = (flat(dk) @ weights["key"].T + flat(dv) @ weights["value"].T).reshape(x.shape)
    dx[:, CONTEXT - laid.scored :] += dh + (flat(dq) @ weights["query"].T).reshape(own.shape)
    for name, ids in (("first", laid.first), ("last", laid.last)):
        g[name] = _add_rows(ids[keys].ravel(), flat(dx), CLASSES)
    return g


def train_on(weights: dict[str, np.ndarray], blocks: Iterable[Windows], seed: int = 3, rate: float = RATE) -> tuple[dict[str, np.ndarray], int]:
    """Adam steps over all windows of some blocks, in random order within stretches of blocks."""
    flat = np.concatenate([weights[k].ravel() for k in _SHAPES])
    ends = np.cumsum([weights[k].size for k in _SHAPES])
    weights = {k: part.reshape(shape) for (k, shape), part in zip(_SHAPES.items(), np.split(flat, ends[:-1]), strict=True)}
    mean, square, g, change = (np.zeros_like(flat) for _ in range(4))
    rng = np.random.Generator(np.random.PCG64(seed))
    steps: list[tuple[Windows, np.ndarray]] = []
    made = size = 0

    def learn(order: np.ndarray) -> None:
        nonlocal made, flat, mean, square, g, change
        for i in order:
            made += 1
            found = gradients(weights, *steps[i])
            np.concatenate([found[k].ravel() for k in _SHAPES], out=g)
            np.multiply(g, g, out=change)
            change -= square
            change *= np.float32(0.01)
            square += change
            g -= mean
            g *= np.float32(0.1)
            mean += g
            np.multiply(square, np.float32(1 / (1 - 0.99**made)), out=change)
            np.sqrt(change, out=change)
            change += np.float32(1e-6)
            np.divide(mean, change, out=change)
            change *= np.float32(rate / (1 - 0.9**made))
            np.subtract(flat, change, out=flat)

    for b in blocks:
        size += len(b.target)
        if len(b.keys):
            steps += [(b, chunk) for chunk in np.array_split(rng.permutation(len(b.keys)), max(1, len(b.keys) // STEP_WINDOWS))]
        if len(steps) >= MIN_STEPS:
            learn(rng.permutation(len(steps)))
            steps.clear()
    if steps:
        total = max(len(steps), MIN_STEPS - made)
        learn(np.concatenate([rng.permutation(len(steps)) for _ in range(-(-total // len(steps)))])[:total])
    return weights, size


def train(docs: DataFrame, counts: Counts, vocabulary: str, doc: str = "doc_id", text: str = "text") -> dict[str, np.ndarray]:
    """Rounds of training in all tasks and averaging; every document is in one of them."""
    weights = initial(counts)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = "merger int, size long, weights binary"

    def batch_of(merger: int, size: int, total: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([merger], pa.int32()), pa.array([size], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["merger", "size", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = 0, np.zeros(_SIZE)
        for batch in batches:
            for n, data in zip(batch.column("size").to_pylist(), batch.column("weights"), strict=True):
                size += n
                total += np.frombuffer(data.as_buffer(), "<f8")
        if size:
            yield batch_of(0, size, total)

    for part in range(ROUNDS):
        share = docs.filter(F.pmod(F.xxhash64(doc), F.lit(ROUNDS)) == part).select(text)
        begin, rate = weights, RATE * (1 - part / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (lay_out(code_block(block, vocabulary), shared.value, CONTEXT) for batch in batches for block in text_blocks(batch.column(0)))
            learned, size = train_on(begin, blocks, rate=rate)
            if size:
                yield batch_of(TaskContext.get().partitionId() % MERGERS, size, np.concatenate([learned[k].ravel() for k in _SHAPES]) * float(size))

        # Sums of sums: however many tasks trained, no task adds up more than its share and one row comes back.
        some = share.mapInArrow(run, schema).repartition(MERGERS, "merger").mapInArrow(add, schema)
        averaged = some.repartition(1).mapInArrow(add, schema).collect()
        if averaged:
            mean = np.frombuffer(averaged[0].weights, "<f8") / averaged[0]["size"]
            ends = np.cumsum([int(np.prod(x)) for x in _SHAPES.values()])
            weights = {k: x.reshape(shape).astype(np.float32) for (k, shape), x in zip(_SHAPES.items(), np.split(mean, ends[:-1]), strict=True)}
    return weights


def score_block(weights: dict[str, np.ndarray], coded: Coded, counts: Counts, chunk: int = 192) -> np.ndarray:
    """Sum of the natural logs of P(class | before) over each text, its end included."""
    laid = lay_out(coded, counts, STRIDE)
    total = np.zeros(len(laid.keys))
    for at in range(0, len(laid.keys), chunk):
        total[at : at + chunk] = forward(weights, laid, slice(at, at + chunk)).sum(axis=1)
    per_row = -(-np.diff(laid.bounds) // STRIDE)
    ends = np.cumsum(per_row)
    sums = np.concatenate([[0.0], np.cumsum(total)])
    return sums[ends] - sums[ends - per_row]


def _scored(docs: DataFrame, counts: Counts, weights: dict[str, np.ndarray], vocabulary: str, doc: str, text: str) -> DataFrame:
    """Rows of documents (row, doc, n_tokens, known, logs, attention) and of words whose
    count isn't held (row, hash, times)."""
    kind = docs.schema[doc].dataType.simpleString()
    class_cost = np.log10((counts.class_total + counts.class_distinct + 1).astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast((counts, class_cost, weights))
    names = ["row", "doc", "n_tokens", "known", "logs", "attention", "hash", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, class_cost, weights = shared.value
        held_hashes, held_counts = counts.hashes, counts.counts
        at_row = TaskContext.get().partitionId() << 36
        end = int(np.searchsorted(held_hashes, END_HASH))
        end_count = int(held_counts[end]) if end < len(held_hashes) and held_hashes[end] == END_HASH else 0
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                coded = code_block(block, vocabulary)
                n, rows = block.hi - block.lo, coded.words.rows
                order = np.argsort(coded.hashes)
                ranked = coded.hashes[order]
                new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
                distinct = ranked[new]
                place = np.minimum(np.searchsorted(held_hashes, distinct), max(0, len(held_hashes) - 1))
                held = held_hashes[place] == distinct if len(held_hashes) else np.zeros(len(distinct), bool)
                c = np.where(held, held_counts[place], 0) if len(held_hashes) else np.zeros(len(distinct), np.int64)
                group = np.cumsum(new) - 1
                row, is_held = rows[order], held[group]
                logs = np.bincount(row, weights=np.log10(c + 1.0)[group] * is_held, minlength=n) + np.log10(end_count + 1)
                known = np.bincount(row, weights=is_held, minlength=n).astype(np.int64) + (end_count > 0)
                attention = score_block(weights, coded, counts) / _LN10
                attention -= np.bincount(rows, weights=class_cost[counts.class_of[coded.first]], minlength=n) + class_cost[0]
                key = at_row + np.arange(n)
                columns = [pa.array(key), batch.column(doc).slice(block.lo, n), pa.array(coded.words.counts + 1), pa.array(known), pa.array(logs), pa.array(attention), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)
                row, word = row[~is_held], ranked[~is_held]
                if len(row):
                    again = np.lexsort((word, row))
                    row, word = row[again], word[again]
                    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])]))
                    times = np.diff(np.append(first, len(row))).astype(np.int32)
                    m = len(first)
                    columns = [pa.array(key[row[first]]), pa.nulls(m, batch.column(doc).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(word[first]), pa.array(times)]
                    yield pa.RecordBatch.from_arrays(columns, names)
                at_row += n

    return docs.select(doc, text).mapInArrow(run, f"row long, doc {kind}, n_tokens long, known long, logs double, attention double, hash long, times int")


def score(docs: DataFrame, training: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``vocabulary`` is the file of a byte-level tokenizer.  Null and empty texts are
    the end alone.  Rows that share an id, and repeated rows, are scored each for
    itself and all stay.  Without training texts all counts are zero; without
    ``docs`` there are no rows.  Pieces of equal frequency are ranked by their id.  A
    very long text is one row of one task, read in windows.  Other columns, whatever
    their names, are not read.
    """
    limit_batches(docs.sparkSession)
    docs, training = docs.select(doc, text), training.select(doc, text)
    counted = written(word_counts(training, vocabulary, text), "word-counts")
    counts = summarise(counted, pieces_of(vocabulary).size)
    weights = train(training, counts, vocabulary, doc, text)
    scored = written(_scored(docs, counts, weights, vocabulary, doc, text), "lm-scores")
    rare = scored.filter("hash is not null").select("row", "hash", "times")
    tail = counted.filter(F.col("n") < counts.least).select("hash", "n")
    found = rare.join(tail, "hash").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    norm = float(np.log10(counts.total + counts.distinct + 1))
    rows = scored.filter("hash is null").join(found, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return rows.select(
        F.col("doc").alias(doc),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * norm).alias("base_score"),
        (logs + F.col("attention")).alias("score"),
    )
