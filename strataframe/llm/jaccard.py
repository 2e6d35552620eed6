"""Jaccard similarity join of word shingles by token-combination prefixes.

Sets that reach the threshold share signatures from their prefixes, taken in one
order of all shingles, rarest first.  A rare shingle is a signature alone.
Frequent shingles are dealt into classes by hash, and each pair of one class is
a signature, so that a passage found everywhere makes no long lists.  A prefix
is long enough that the shingles by which two similar sets may differ can't
break all shared signatures: a rare shingle counts one, a class of m frequent
ones m - 1.

Candidates are verified on whole sets.  Each set is first compared with the one
lowest neighbour it shares most signatures with; then only sets that meet in a
signature but lie in different components yet are compared.  Their sizes and
bitmaps are compared within tasks, block by block, so that a signature that many
unlike sets share makes no rows: only pairs that may reach the similarity leave
a task, at first the likeliest of each two components and, once these are
joined, all that are left.  So no group of copies is expanded into all its
pairs and no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import SMALL_BATCH_BYTES, lean, limit_batches, written
from .textarrays import ASCII_LOWER, Block, Words, find_words, gram_hashes, gram_starts, mix64, range_hashes, text_blocks

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 80
#: Bytes of text at once; some forty times as much memory is in use meanwhile, in each task.
BLOCK_BYTES = 1 << 19
#: Counters of the frequency sketch: 2 to this power.  Wider keeps more classes apart at scale.
SKETCH_BITS = 22
#: Candidate ids up to which they are broadcast to the texts; beyond it both sides shuffle.
BROADCAST_IDS = 2_000_000
#: Bits of a parity bitmap, 2 to this power: least, at most along with signatures, and at most.
LEAST_BITS, SHORT_BITS, LONG_BITS = 8, 12, 22
#: Sets of a signature that are compared with each other as one block; pairs of bitmaps at once.
BLOCK_SETS, PAIRS_AT_ONCE = 256, 1 << 15
#: Level of slots that are frequent; lower ones tell how rare the others are.
FREQUENT = 255
_CHUNKS = 64
_SMALL = 8


def shingle_sets(block: Block) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row, as ``uint64``.

    A row of fewer than five words, but not none, has one shingle of them all.
    """
    words: Words = find_words(block)
    hashes = range_hashes(ASCII_LOWER[block.data], words.starts, words.ends)
    grams = gram_hashes(hashes, SHINGLE)
    out = []
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            ranked = np.sort(grams[lo : hi - SHINGLE + 1])
            keep = np.empty(len(ranked), bool)
            keep[0] = True
            np.not_equal(ranked[1:], ranked[:-1], out=keep[1:])
            out.append(ranked[keep])
        else:
            out.append(gram_hashes(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def _digest(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart, as signed numbers."""
    a, b = mix64(values + np.uint64(1)), mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def parity_bitmap(values: np.ndarray) -> np.ndarray:
    """Bits (as 0 and 1), two to four for each shingle, of which each shingle flips one.

    Two sets differ in at least as many shingles as their bitmaps in bits.
    """
    bits = 1 << min(LONG_BITS, max(LEAST_BITS, (2 * len(values)).bit_length()))
    return (np.bincount((values >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap that the same set would have with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def digests(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per document (doc, n, h1, h2, short, bits) and rows (chunk, counts) of the sketch.

    The sketch counts, for each slot, the documents of a task that hold a
    shingle falling there; exact copies within a task count once.
    """
    kind = docs.schema[doc].dataType.simpleString()
    names = ["doc", "n", "h1", "h2", "short", "bits", "chunk", "counts"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for block in text_blocks(batch.column(text), BLOCK_BYTES):
                sets = shingle_sets(block)
                maps = [parity_bitmap(s) for s in sets]
                rows = [(len(s), *_digest(s)) for s in sets]
                fresh = []
                for s, row in zip(sets, rows, strict=True):
                    if row[0] and row[1:3] not in seen:
                        fresh.append(s)
                        seen.add(row[1:3])
                if fresh:
                    slots, times = np.unique((np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
                    counts[slots] += times.astype(np.uint32)
                if len(seen) > 200_000:
                    seen.clear()
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                short = pa.array([np.packbits(folded(m, min(len(m), 1 << SHORT_BITS))).tobytes() for m in maps], pa.binary())
                bits = pa.array([np.packbits(m).tobytes() if len(m) > 1 << SHORT_BITS else None for m in maps], pa.binary())
                empty = short, bits, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(doc).slice(block.lo, len(rows)), *numbers, *empty], names)
        chunks = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, _CHUNKS)]
        nothing = [pa.nulls(_CHUNKS, pa.int64())] * 3 + [pa.nulls(_CHUNKS, pa.binary())] * 2
        kind_type = batch_type[0]
        yield pa.RecordBatch.from_arrays([pa.nulls(_CHUNKS, kind_type), *nothing, pa.array(range(_CHUNKS), pa.int32()), pa.array(chunks, pa.binary())], names)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = [to_arrow_type(docs.schema[doc].dataType)]
    return docs.select(doc, text).mapInArrow(run, f"doc {kind}, n long, h1 long, h2 long, short binary, bits binary, chunk int, counts binary")


def slot_levels(passed: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot of the sketch are: ``FREQUENT`` if the count stands
    out from chance, else its distance from the mean in quarters of a standard deviation."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(data.as_buffer()), "<u4").astype(np.int64)
        values = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(values, pa.binary())], ["chunk", "counts"])

    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(counts) // _CHUNKS
    chunks = passed.filter("chunk is not null").select("chunk", "counts").repartition(_CHUNKS, "chunk")
    for row in chunks.mapInArrow(run, "chunk int, counts binary").collect():  # one row of a fixed size per chunk
        counts[row.chunk * width : (row.chunk + 1) * width] += np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    mean = counts.mean()
    levels = np.clip(np.rint(4 * (counts - mean) / np.sqrt(mean + 1)) + 100, 0, FREQUENT - 1)
    return np.where(counts > mean + 4 * np.sqrt(mean) + 8, FREQUENT, levels).astype(np.uint8)


def _tag(tokens: np.ndarray, band: int) -> np.ndarray:
    return mix64(tokens + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def signatures(values: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set, and which of them are leading.

    Two sets that reach ``percent`` share at least one that leads in the smaller set, or in
    either of equally large ones: so much of a set must be common with any larger
    one that the first common shingle comes early.
    """
    n = len(values)
    if n == 0:
        return values, np.zeros(0, bool)
    need = n - (percent * n + 99) // 100 + 1
    level = levels[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    common = level == FREQUENT
    rare = values[~common]
    rare = rare[np.argsort(level[~common], kind="stable")]
    if len(rare) >= need:
        lead = n - (2 * percent * n + 99 + percent) // (100 + percent) + 1
        return rare[:need], np.arange(need) < lead
    tokens, lack = values[common], need - len(rare)
    parts = [rare]
    base = 100 / percent
    band = int(np.floor(np.log(n) / np.log(base) + 1e-9))
    for version in (band, band + 1):  # similar sets lie in the same band or in adjacent ones
        low = base**version
        if low < _SMALL:
            parts.append(_tag(tokens[:lack], version))
            continue
        classes = (mix64(tokens) % np.uint64(max(1, int(low / 10)))).astype(np.int64)
        again = np.ones(len(tokens), bool)
        again[np.unique(classes, return_index=True)[1]] = False
        used = int(np.searchsorted(np.cumsum(again), lack)) + 1
        tagged = _tag(tokens[:used], version)
        order = np.argsort(classes[:used], kind="stable")
        grouped = classes[:used][order]
        cuts = np.flatnonzero(np.diff(grouped)) + 1
        for group in np.split(tagged[order], cuts):
            if len(group) > 1:
                pairs = np.array(list(combinations(group.tolist(), 2)), np.uint64)
                parts.append(mix64(pairs[:, 0] * np.uint64(3) + pairs[:, 1]))
    found = np.unique(np.concatenate(parts))
    return found, np.ones(len(found), bool)


def signature_rows(docs: DataFrame, levels: np.ndarray, doc: str, text: str) -> DataFrame:
    """(sig, doc, leads); of exact copies within a task only the first emits rows."""
    kind = docs.schema[doc].dataType.simpleString()
    packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for block in text_blocks(batch.column(text), BLOCK_BYTES):
                found, picks = [], []
                for i, values in enumerate(shingle_sets(block)):
                    key = _digest(values)
                    if len(values) and key not in seen:
                        seen.add(key)
                        found.append(signatures(values, levels))
                        picks.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                if found:
                    rows = np.repeat(np.array(picks) + block.lo, [len(x) for x, _ in found])
                    sigs, leads = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), batch.column(doc).take(pa.array(rows)), pa.array(leads)], ["sig", "doc", "leads"])

    return docs.select(doc, text).mapInArrow(run, f"sig long, doc {kind}, leads boolean")


def _texts(docs: DataFrame, ids: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text) of the documents whose id is in ``ids``."""
    ids = ids.select(F.col("doc").alias("__sf_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    return chosen.join(ids, F.col("doc") == F.col("__sf_id"), "left_semi")


def _room(total: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of so many shingles together, of which so many are surely not common, may be similar."""
    return (total - apart) * (100 + percent) >= total * 2 * percent


def _meeting(rows: dict[str, np.ndarray], percent: int, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of rows of one cell that may be similar; cells lie in one piece.

    ``best`` leaves the likeliest pair of each two components of a cell, and tells
    whether there were more.
    """
    cell, n, band, version, leads = (rows[k] for k in ("cell", "n", "band", "version", "leads"))
    ends = np.searchsorted(cell, cell, side="right") if len(cell) else np.zeros(0, np.int64)
    ahead = ends - np.arange(len(cell)) - 1
    cuts = np.searchsorted(np.cumsum(ahead), np.arange(0, ahead.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="left")
    found = []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(cell)), strict=True):
        count = ahead[lo:hi]
        left = np.repeat(np.arange(lo, hi), count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        ok = (rows["component"][left] != rows["component"][right]) & (rows["whole"][left] | (rows["side"][left] != rows["side"][right]))
        # Each two bands meet in one version.
        ok &= np.maximum(band[left], band[right]) == version[left]
        ok &= np.minimum(n[left], n[right]) * 100 >= np.maximum(n[left], n[right]) * percent
        m, o = n[left], n[right]
        ok &= (leads[left] & (m <= o)) | (leads[right] & (o <= m))
        left, right = left[ok], right[ok]
        width = np.minimum(rows["width"][left], rows["width"][right])
        apart = np.zeros(len(left), np.int64)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            used, place = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
            maps = np.stack([_words_of(rows["short"][i], int(w)) for i in used])
            x, y = place[: len(at)], place[len(at) :]
            for k in range(0, len(at), 4096):
                apart[at[k : k + 4096]] = np.bitwise_count(maps[x[k : k + 4096]] ^ maps[y[k : k + 4096]]).sum(axis=1)
        ok = _room(n[left] + n[right], apart, percent)
        some = left[ok], right[ok], apart[ok], np.ones(ok.sum(), np.int64)
        found.append(_likeliest(rows, *some) if best else some)
    left, right, apart, times = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    if best:
        left, right, apart, times = _likeliest(rows, left, right, apart, times)
    return left, right, times > 1


def _likeliest(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, apart: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs of the same cell and components the one least apart, and how many it stands for."""
    if len(left) == 0:
        return left, right, apart, times
    a, b = rows["component"][left], rows["component"][right]
    low, high, cell = np.minimum(a, b), np.maximum(a, b), rows["cell"][left]
    order = np.lexsort((apart / (rows["n"][left] + rows["n"][right]), high, low, cell))
    keys = np.stack([cell, low, high])[:, order]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return left[order[first]], right[order[first]], apart[order[first]], np.add.reduceat(times[order], first)


def _words_of(packed: bytes, width: int) -> np.ndarray:
    """A packed bitmap, folded to so many bytes, as 64-bit words."""
    bits = np.frombuffer(packed, np.uint64)
    return np.bitwise_xor.reduce(bits.reshape(-1, width // 8), axis=0)


def contested_cells(placed: DataFrame, passed: DataFrame, percent: int) -> DataFrame:
    """(sig, cell, doc, ...): blocks of sets of different components that meet in a signature.

    ``placed`` has (sig, doc, leads, component).  The sets of a signature are dealt by size
    into bands and within these by hash into blocks; a cell is two blocks to compare.
    """
    split = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("sig")
    sizes = passed.filter("n > 0").groupBy("doc").agg(F.max("n").alias("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    sized = placed.join(split, "sig").join(sizes.select("doc", band.alias("band")), "doc").withColumn("version", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    shares = sized.groupBy("sig", "version", "component").agg(F.count(F.lit(1)).alias("m"), F.max("leads").alias("led"), F.max("band").alias("top"))
    lists = shares.groupBy("sig", "version").agg(F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("component", F.struct("m", "component")).alias("major"), F.max("led").alias("led"), F.max("top").alias("top"))
    lists = lists.filter("most < m and led and top = version")
    # Sets of the largest component needn't meet each other: they are dealt over blocks of
    # their own, numbered from -1 down, and meet only the blocks of the others.
    majors, others = F.ceil(F.col("most") / BLOCK_SETS).cast("int"), F.ceil((F.col("m") - F.col("most")) / BLOCK_SETS).cast("int")
    dealt = sized.join(lists.select("sig", "version", "major", majors.alias("majors"), others.alias("others")), ["sig", "version"])
    large = F.col("component") == F.col("major")
    dealt = dealt.withColumn("own", F.when(large, -1 - F.pmod(F.xxhash64("doc"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("doc"), F.col("others"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(large, F.lit(0)).otherwise(-F.col("majors")), F.col("others") - 1)))
    cell = F.xxhash64("sig", "version", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select("sig", cell.alias("cell"), "doc", "band", "version", "leads", (F.col("own") == F.col("other")).alias("whole"), (F.col("own") < F.col("other")).alias("side"))


def contested_pairs(cells: DataFrame, parts: DataFrame, passed: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, sig, more): pairs of sets of different components in a cell that may be similar."""
    kind = cells.schema["doc"].dataType.simpleString()
    digest = passed.filter("n > 0").groupBy("doc").agg(F.max(F.struct("n", "short")).alias("s")).select("doc", "s.n", "s.short")
    known = digest.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    ready = cells.join(known, "doc").repartition("cell").sortWithinPartitions("cell")

    def judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "band", "version", "leads", "whole", "side")}
        rows["short"] = table.column("short").to_pylist()
        rows["width"] = np.array([len(x) for x in rows["short"]], np.int64)
        codes = table.column("component").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        rows["component"] = codes.indices.to_numpy(zero_copy_only=False)
        left, right, more = _meeting(rows, percent, best)
        docs = table.column("doc").combine_chunks()
        return pa.RecordBatch.from_arrays([*(_flat(docs.take(pa.array(x))) for x in (left, right)), _flat(table.column("sig").take(pa.array(left))), pa.array(more)], ["a", "b", "sig", "more"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            if held and batch.num_rows and cells[0] == held[-1].column("cell")[-1].as_py():
                cut = int(np.searchsorted(cells, cells[0], side="right"))  # the cell goes on
                held.append(batch.slice(0, cut))
                batch, cells = batch.slice(cut), cells[cut:]
            if batch.num_rows:
                if held:
                    yield judged(held)
                last = int(np.searchsorted(cells, cells[-1], side="left"))  # what may go on in the next batch
                if last:
                    yield judged([batch.slice(0, last)])
                held = [batch.slice(last)]
        if held:
            yield judged(held)

    return ready.mapInArrow(run, f"a {kind}, b {kind}, sig long, more boolean")


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def plausible(pairs: DataFrame, passed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of (a, b) whose sizes and whole bitmaps leave room for the similarity."""
    kind = pairs.schema["a"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (large.slice(k, 500) for large in batches for k in range(0, large.num_rows, 500)):
            keep = []
            for x, y, m, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                ok = min(x, y) * 100 >= max(x, y) * percent
                if ok:
                    width = min(len(m), len(n))
                    ok = bool(_room(x + y, int(np.bitwise_count(_words_of(m, width) ^ _words_of(n, width)).sum()), percent))
                keep.append(ok)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    maps = passed.filter("n > 0").select("doc", "n", F.coalesce("bits", "short").alias("bits"))
    both = pairs.join(maps.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    both = both.join(maps.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def verified(pairs: DataFrame, docs: DataFrame, doc: str, text: str, percent: int = PERCENT) -> DataFrame:
    """Those of (a, b) whose sets reach the similarity, found from their whole texts.

    Texts move rather than sets, since they are a fraction of the size.
    """
    kind = docs.schema[doc].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (large.slice(k, 100) for large in batches for k in range(0, large.num_rows, 100)):
            sets = [[s for block in text_blocks(batch.column(k), BLOCK_BYTES) for s in shingle_sets(block)] for k in (2, 3)]
            keep = []
            for x, y in zip(*sets, strict=True):
                small, large = min(len(x), len(y)), max(len(x), len(y))
                common = 0
                if small * 100 >= large * percent and small:
                    both = np.sort(np.concatenate([x, y]))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common > 0 and common * 100 >= (len(x) + len(y) - common) * percent)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    texts = _texts(docs, ids, doc, text)
    both = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def link(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, n_shingles, component_id) of every row of ``docs``.

    Component ids are the lowest doc among those reachable by links, itself
    included.  A null or empty text, or one without words, has no shingles and
    links with nothing.  Rows that share an id are one node; a null id stays
    alone, with a null component.  A very long text is one set, within one task, and
    compared like any other.  Equal sets are one class, whose lowest id stands for it;
    of equally good neighbours the lowest is tried first.  An empty table gives an
    empty one.  Other columns, whatever their names, are not read.
    """
    limit_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    docs = docs.select(doc, text)
    passed = written(digests(docs, doc, text), "digests")
    rows = passed.filter("chunk is null").select("doc", "n", "h1", "h2")
    copies = rows.filter("n > 0 and doc is not null").groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    # Apart from the sums, so that a large group of copies can be dealt over tasks.
    copies = written(copies.drop("m"), "copies")
    reps = rows.join(copies, ["n", "h1", "h2"]).filter("doc != rep").select("doc", "rep")

    sigs = signature_rows(docs.filter(F.col(doc).isNotNull()), slot_levels(passed), doc, text)
    within = Window.partitionBy("sig")
    met = sigs.withColumn("lo", F.min("doc").over(within)).withColumn("hi", F.max("doc").over(within)).withColumn("led", F.max("leads").over(within))
    # Copies that met across tasks fall together.
    met = met.filter("lo < hi and led").join(reps, "doc", "left").groupBy("sig", F.coalesce("rep", "doc").alias("doc")).agg(F.max("leads").alias("leads"))
    met = written(met, "signatures")
    low = met.groupBy("sig").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").drop("hi")
    shared = met.join(low, "sig").filter("doc != lo").groupBy("doc", "lo").agg(F.count(F.lit(1)).alias("n"))
    first = shared.groupBy("doc").agg(F.max_by("lo", F.struct("n", -F.col("lo"))).alias("lo"))
    first = written(plausible(first.select(F.col("lo").alias("a"), F.col("doc").alias("b")), passed, percent), "first-pairs")
    links = written(verified(first, docs, doc, text, percent), "links")
    for best in (True, False):
        parts = components(links)
        placed = met.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").select("sig", "doc", "leads", F.coalesce("component", "doc").alias("component"))
        cells = written(contested_cells(placed, passed, percent), "cells")
        found = written(contested_pairs(cells, parts, passed, percent, best), "cell-pairs")
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = written(plausible(pairs, passed, percent), "rest-pairs")
        links = links.unionByName(written(verified(rest, docs, doc, text, percent), "links"))
        # Only signatures with more than the likeliest pairs come again.
        again = found.filter("more").select("sig").distinct()
        if not best or again.isEmpty():
            break
        met = written(met.join(again, "sig", "left_semi"), "signatures")
    copied = reps.select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    final = components(links.unionByName(copied)).select(F.col("node").alias("doc"), "component")
    joined = rows.join(final, "doc", "left")
    return joined.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document, the lowest id, of each component; all its columns.

    Rows of that id all stay, and so do rows of a null id and texts without words.
    """
    kept = link(docs, doc, text, percent).filter(F.col(doc).isNull() | (F.col(doc) == F.col("component_id"))).select(F.col(doc).alias("__sf_kept")).distinct()
    return docs.join(kept, F.col(doc).eqNullSafe(F.col("__sf_kept")), "left_semi")
