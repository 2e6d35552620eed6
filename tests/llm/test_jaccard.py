import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from strataframe.llm import jaccard as j
from strataframe.llm.components import components


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 60, 150]))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], "new"]])
            rows.append(" ".join(copy))
    for _ in range(40):  # one passage that many documents share, with little else or much
        own = rng.choices(vocabulary, k=rng.choice([1, 3, 40]))
        rows.append(" ".join(passage + own))
    rows += ["", None, "  \n", "one", "ONE", "one two", "Ünï x", "ünï x", "a b c d e", "A\tb c\nd e"]
    return list(enumerate(rows))


@pytest.mark.parametrize("everything_frequent", [False, True])
def test_links_against_brute_force(spark, monkeypatch, everything_frequent):
    if everything_frequent:
        monkeypatch.setattr(j, "slot_levels", lambda passed: np.full(1 << j.SKETCH_BITS, j.FREQUENT, np.uint8))
        monkeypatch.setattr(j, "BLOCK_SETS", 4)
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component string, a string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.link(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_similar_sets_share_a_signature(share):
    rng = np.random.Generator(np.random.PCG64(5))
    frequent = np.where(rng.random(1 << j.SKETCH_BITS) < share, j.FREQUENT, rng.integers(0, 200, 1 << j.SKETCH_BITS)).astype(np.uint8)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        m = int(np.ceil(n * 0.8 + rng.random() * n * 0.2))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        x, y = base, np.concatenate([base[:m], rng.integers(0, 1 << 63, int(m / 0.8 - n) if m / 0.8 > n else 0, dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            (one, led), (two, leads) = j.signatures(x, frequent), j.signatures(y, frequent)
            small, large = (one[led], two) if len(x) <= len(y) else (two[leads], one)
            assert len(np.intersect1d(small, large))


def test_long_sets_that_share_signatures_but_are_not_similar(spark, monkeypatch):
    """Hundreds of long sets with a common passage: few pairs leave a task and no link is lost."""
    monkeypatch.setattr(j, "slot_levels", lambda passed: np.full(1 << j.SKETCH_BITS, j.FREQUENT, np.uint8))
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=200)
    rows = [" ".join(passage + rng.choices(vocabulary, k=600)) for _ in range(150)]
    near = rows[7].split()
    for k in range(0, 800, 100):
        near[k] = "other"
    rows += [" ".join(near), " ".join(near[20:])]
    seen = []
    real = j.contested_pairs
    monkeypatch.setattr(j, "contested_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.link(df).collect()}
    assert got == brute(list(enumerate(rows)))
    assert sum(x.count() for x in seen) < 20


@pytest.mark.parametrize("percent", [60, 95])
def test_other_thresholds(percent):
    rng = np.random.Generator(np.random.PCG64(6))
    levels = np.where(rng.random(1 << j.SKETCH_BITS) < 0.5, j.FREQUENT, 3).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(5, 150))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(x[: int(np.ceil(len(x) * percent / 100))])
        if 100 * len(y) >= percent * len(x):
            (one, _), (two, led) = j.signatures(x, levels, percent), j.signatures(y, levels, percent)
            assert len(np.intersect1d(one, two[led]))


def test_same_ids_nulls_and_nothing(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    got = j.link(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert j.link(spark.createDataFrame([], schema)).collect() == []
    kept = j.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 1]


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 150), (150, 170)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 150, 150: 150, 170: 150}


def test_a_task_gives_its_memory_back():
    """In a process of its own, as freed memory of other tests would count too."""
    code = """
from strataframe.llm.shared import lean
def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) // 1024
def run(batches):
    for x in batches:
        many, keep = [bytes(3000) for _ in range(100_000)], bytes(10)
        yield x
before = held()
assert list(lean(run)(iter([1, 2]))) == [1, 2]
assert held() < before + 100, (before, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])
