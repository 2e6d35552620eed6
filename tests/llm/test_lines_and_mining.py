"""Line dedup, hard negatives and resampling against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from strataframe.llm import hard_negatives as h
from strataframe.llm import line_dedup as l
from strataframe.llm import resampling as r

SPACES = " \t\n\v\f\r"
LINES = ["A shared line of some length", "a SHARED line of some length  ", "another line that is shared é", "short one", "exactly twenty chars", "nineteen characters", "\x0btabbed and shared by many\r", "日本語の行はここにありますので二十文字以上です", "", "   "]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def kept_lines(docs):
    """(n_lines, n_dropped, text) of each (id, text), by the contract."""
    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None:
                held.setdefault(lowered(line.strip(SPACES)), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        keys = [lowered(x.strip(SPACES)) for x in lines]
        keep = [x for x, k in zip(lines, keys) if i is None or len(k) < 20 or len(held[k]) < 3 or max(held[k]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def line_docs(seed=1, n=120):
    rng = random.Random(seed)
    docs = [(k, "\n".join(rng.choice(LINES) if rng.random() < 0.4 else f"a line of its own number {rng.randrange(150)}" for _ in range(rng.randint(0, 8)))) for k in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (3, LINES[0]), (3, LINES[0]), (None, LINES[0] + "\nx"), (None, None), (n + 3, "\n".join(LINES * 6000)), (n + 4, "é" * 19 + "\n" + LINES[4])]


@pytest.mark.parametrize(("bits", "broadcast", "heavy"), [(None, 1_000_000, 1e-4), (20, 0, 1e-4), (8, 0, 1.0), (22, 1_000_000, 0.0)])
def test_line_dedup_against_brute_force(spark, monkeypatch, bits, broadcast, heavy):
    """Small filters suspect every line, wide ones few; broadcast or shuffled, heavy or light, the rows are the same."""
    monkeypatch.setattr(l, "BROADCAST_DROPS", broadcast)
    monkeypatch.setattr(l, "HEAVY_SHARE", heavy)
    docs = line_docs()
    table = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_lines int, drops string").repartition(5)
    got = [tuple(x) for x in l.clean_lines(table, bits=bits).collect()]
    assert sorted(got, key=str) == sorted(kept_lines(docs), key=str)


def test_heavy_line_keys_are_dropped_too(spark, monkeypatch):
    docs = [(k, LINES[0] + f"\nline number {k} of its own kind") for k in range(1500)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows, shared = l.shared_lines(table)
    assert [(x.keeper, x.n) for x in shared.collect()] == [(1499, 1500)]
    assert sum(x.n_dropped for x in l.clean_lines(table).collect()) == 1499


def test_filters_of_tasks_miss_no_repeat(spark):
    docs = [(k, f"this line is here in two documents {k // 2}") for k in range(4000)] + [(k + 4000, f"this line is here in one document only {k}") for k in range(4000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = l.suspected(table, l.twice_seen(table, "doc_id", "text", 20), "doc_id", "text")
    ids = {x.doc for x in found.collect()}
    assert ids >= set(range(4000)) and len(ids) < 4400


def test_dedup_lines_keeps_rows_and_columns(spark):
    docs = line_docs(2)
    table = spark.createDataFrame([(i, t, 5, "k") for i, t in docs], "doc_id long, text string, n_dropped int, k1 string").repartition(3)
    out = l.dedup_lines(table)
    assert out.columns == table.columns
    want = [(i, None if t is None else x[3]) for (i, t), x in zip(docs, kept_lines(docs), strict=True)]
    assert sorted([(x.doc_id, x.text) for x in out.collect()], key=str) == sorted(want, key=str)
    assert l.dedup_lines(table.limit(0)).count() == 0 and l.clean_lines(table.limit(0)).count() == 0


def mined(rows):
    """The contract, pair by pair."""
    rows = sorted({(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, c, v in rows:
        if i % 50 == 0:
            all_rows = sorted((-dot(v, w), j, d) for j, d, w in rows if j != i)
            for s, p, _ in [x for x in all_rows if x[2] == c][:5]:
                fits = [(j, -t) for t, j, d in all_rows if d != c and 50 * -s <= 100 * -t <= 95 * -s]
                out += [(i, p, k + 1, j, -s, t) for k, (j, t) in enumerate(fits[:3])]
    return out


@pytest.mark.parametrize(("bucket", "anchors", "at_once"), [(2048, 32_768, 512), (7, 4, 3)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, bucket, anchors, at_once):
    for name, value in (("BUCKET_ROWS", bucket), ("ANCHORS_AT_ONCE", anchors), ("ROWS_AT_ONCE", at_once)):
        monkeypatch.setattr(h, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(420):
        v = (rng.normal(0, 1, 6) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist()
        rows.append((int(k * 5), int(rng.integers(0, 3)), v))
    rows += [(7000 + 5 * k, k % 2, [1.0] + [0.0] * 5) for k in range(60)]  # ties and a hot vector
    rows += [(50, 1, rows[9][2]), (50, 1, rows[9][2]), (100, 0, None), (150, None, rows[3][2]), (200, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (250, 1, [float("nan")] * 6), (300, 1, [float("inf")] * 6), (None, 1, rows[3][2]), (8000, 1, [1.0, 2.0]), (8050, 1, []), (9000, 77, [1.0] * 6)]
    table = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, label int, embedding array<float>, score int, v string").repartition(5)
    got = [tuple(x) for x in h.mine(table).collect()]
    assert sorted(got) == sorted(mined(rows)) and len(got) > 60


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert h.mine(spark.createDataFrame([], schema)).count() == 0
    assert h.mine(spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], schema)).count() == 0
    large = [(0, 1, [2.0**20, 1.0]), (1, 1, [2.0**20, 0.0]), (2, 2, [2.0**19, 0.5]), (3, 2, [2.0**19, 0.0])]
    assert [tuple(x) for x in h.mine(spark.createDataFrame(large, schema)).collect()] == mined(large)
    with pytest.raises(Exception, match="don't fit"):
        h.mine(spark.createDataFrame([(0, 1, [1e12]), (1, 1, [1e12])], schema)).collect()


def test_pruned_buckets_change_nothing():
    """What a bucket's length bound leaves out can't be among the best."""
    best = h._Best(2, 2)
    best.add(np.array([0, 1]), np.array([[5, 9, 9], [1, h._LEAST, h._LEAST]]), np.array([3, 4, 8]))
    assert best.score.tolist() == [[9, 9], [1, h._LEAST]] and best.id[0].tolist() == [4, 8]
    best.add(np.array([0]), np.array([[9, 2]]), np.array([1, 2]))
    assert best.id[0].tolist() == [1, 4] and best.limit().tolist() == [9, h._LEAST]


def contract_words(text):
    return "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in lowered(text or "")).split(" ")


def grams(text, longest=2):
    w = [x for x in contract_words(text) if x]
    return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def resampled(docs, bench, longest=2, buckets=10_000, least=20, percent=25):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    found, counts = [grams(t, longest) for _, t in docs], []
    for texts in ([f for _, f in found], [grams(t, longest)[1] for t in bench]):
        c = {}
        for f in texts:
            for x in f:
                c[bucket(x)] = c.get(bucket(x), 0) + 1
        counts.append(c)
    (s, t), (big, target) = counts, [sum(c.values()) for c in counts]
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (big + buckets) / ((s.get(b, 0) + 1) * (target + buckets))))
    rows = []
    for (i, _), (n, f) in zip(docs, found, strict=True):
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        u = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None])
    can = sorted((x for x in rows if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0], x[2], x[1]))
    for k, x in enumerate(can[: len(can) * percent // 100]):
        x[5] = k + 1
    return [tuple(x) for x in rows]


@pytest.mark.parametrize(("longest", "array_bytes"), [(2, 4 << 20), (2, 64), (3, 300)])
def test_resampling_against_brute_force(spark, monkeypatch, longest, array_bytes):
    monkeypatch.setattr(r, "ARRAY_BYTES", array_bytes)
    rng = random.Random(3)
    vocabulary = "alpha Beta gamma-delta é日 x1 the The river stone\x7fwood 42 ab".split(" ")
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "one two " * 20_000), (5, "one two " * 30), (5, "one two " * 30), (None, "the river " * 15), (None, None)]
    bench = ["the river stone", None, "", "alpha beta alpha beta", "ab 42 ab 42"]
    table = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, weight int, rank string").repartition(4)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    got = [tuple(x) for x in r.resample(table, target, longest=longest).collect()]
    assert sorted(got, key=str) == sorted(resampled(docs, bench, longest), key=str)


def test_resampling_of_no_rows_and_drawn_rows(spark):
    docs = spark.createDataFrame([(k, "word " * 25, "k") for k in range(40)], "doc_id long, text string, rank string")
    target = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert r.resample(docs.limit(0), target).count() == 0
    empty = r.resample(docs, target.limit(0)).collect()
    assert len(empty) == 40 and sorted(x["rank"] for x in empty if x["rank"]) == list(range(1, 11))
    kept = r.drawn(docs, target)
    assert kept.columns == docs.columns and kept.count() == 10


def test_suffix_array_of_words_is_sorted_and_knows_common_words():
    rng = np.random.default_rng(1)
    ids, size = rng.integers(0, 4, 60), np.array([0, 13, 1, 46])
    left = np.concatenate([np.arange(n, 0, -1) for n in size])
    order, common = r.suffix_array(ids, left, 3)
    text = [tuple(ids[k : k + min(3, left[k])]) for k in order]
    assert text == sorted(text) and sorted(order.tolist()) == list(range(60))
    for a, b, n in zip(text, text[1:], common[1:]):
        assert n == next((k for k in range(3) if a[k : k + 1] != b[k : k + 1] or len(a) <= k), 3)
