import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe.llm import decontaminate as d
from strataframe.llm import language as g
from strataframe.llm import quality_model as m
from strataframe.llm import quality_rules as r
from strataframe.llm.textarrays import text_blocks

ODD = [None, "", " \n\t ", "x", "123 $$$", "a " * 3000, "É é ß", "line one here\nline one here\n\nother\n", "x\x0by"]


def frame(spark, texts=ODD):
    rows = [(i, t, "src", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n_words int").repartition(3)


def split(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]


def test_rule_counts_against_brute_force(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choices("a bb ccc# d| E".split(), k=rng.randint(0, 60))) + "\n" * rng.randint(0, 2) + "tail" for _ in range(60)]
    texts += ["p q r s t u v w " * 3 + "and more", "a b\na b\na b \n\n"]
    got = {x.doc_id: x for x in r.ledger(r.measure(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w, lines, hit = split(t), [x for x in (t or "").split("\n") if split(x)], set()
        where = {}
        for k in range(len(w) - 7):
            where.setdefault(tuple(w[k : k + 8]), []).append(k)
        for places in where.values():
            if len(places) > 1:
                hit.update(k + j for k in places for j in range(8))
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(lines), sum("A" <= c <= "Z" for c in t or ""), sum(x == y for x, y in zip(w, w[1:])))
        assert tuple(got[i][c] for c in r.COUNTS) == want
        assert bool(got[i].failed & 3) == (len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_ablation_and_policies(spark):
    led = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed long")
    rows = {x.rule: (x.n_failed, x.n_sole) for x in r.ablation(led, "v1").collect()}
    assert rows["few_words"] == (3, 2) and rows["repeated_windows"] == (1, 0) and rows["symbols"] == (1, 1)
    assert led.filter(r.keeps("v1")).count() == 1 and led.filter(r.keeps("base")).count() == 2
    assert all(x.n_failed == 0 for x in r.ablation(led.limit(0), "v1").collect())


def test_language_against_brute_force(spark):
    rows = [("en", "the cat and the dog " * 5), ("en", "that house is the best"), ("de", "der hund und die katze " * 5), ("de", "das haus ist schön"), (None, "ignored zzz"), ("fr", "le chat été où ça")]
    train = spark.createDataFrame(rows, "lang string, text string")
    profiles = g.learn(train, size=40)

    def grams(text):
        s = ["_"] + [c.lower() if c.isalpha() else "_" for c in text] + ["_"]
        out = {}
        for k in range(len(s)):
            for n in (1, 2, 3):
                x = tuple(s[k : k + n])
                if len(x) == n and set(x) != {"_"} and "_" not in x[1:-1]:
                    out[x] = out.get(x, 0) + 1
        return out

    code = lambda x: [1 if c == "_" else ord(c) for c in x]
    value = lambda x: sum(c << 16 * (len(x) - 1 - i) for i, c in enumerate(code(x)))
    rank = lambda counts: {x: i for i, x in enumerate(sorted(counts, key=lambda x: (-counts[x], value(x)))[:40])}
    want = {}
    for lang in ("en", "de", "fr"):
        total = {}
        for l, t in rows:
            if l == lang:
                for x, n in grams(t).items():
                    total[x] = total.get(x, 0) + n
        want[lang] = rank(total)
    texts = [t for _, t in rows] + ["a dog", "Das", "x", "", None, "12 34", "ÜBER", "𝒳 abc"]
    assert profiles.langs == ["de", "en", "fr"]
    got = {x.doc_id: x for x in g.identify(frame(spark, texts), profiles).collect()}
    for i, t in enumerate(texts[:-1]):
        own = rank(grams(t or ""))
        far = {l: sum(abs(p[x] - k) if x in p else 40 for x, k in own.items()) for l, p in want.items()}
        expected = min(sorted(far), key=far.get) if any(c.isalpha() for c in t or "") else "und"
        assert got[i].lang_pred == expected, (t, far)
        assert 0 <= got[i].score <= 1
    assert g.identify(frame(spark), g.learn(train.limit(0))).filter("lang_pred != 'und'").count() == 0
    assert g.identify(frame(spark, []), profiles).count() == 0


def test_quality_model_learns_and_scores_odd_texts(spark):
    rng = random.Random(0)
    words = "the of and house tree river stone light".split()
    good = [" ".join(rng.choices(words, k=30)) + "." for _ in range(150)]
    bad = [" ".join(w + "###" for w in rng.choices(words, k=30)) for _ in range(75)] + [" ".join(w for w in rng.choices(words, k=4) for _ in range(9)) for _ in range(75)]
    docs = frame(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300) if i % 4] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = m.fit(docs, labels)
    rows = m.score(docs, model).collect()
    held = [x for x in rows if x.doc_id < 300 and x.doc_id % 4 == 0]
    assert sum((x.predicted == 1) == (x.doc_id < 150) for x in held) >= 0.95 * len(held)
    assert len(rows) == 300 + len(ODD) and all(0 <= x.score <= 1 for x in rows)
    assert m.train(["a"], [1]).scores(next(iter(text_blocks(pa.array(["b", ""])))))[0] > 0.5
    assert m.score(docs.limit(0), model).count() == 0 and m.score(docs.union(docs), model).count() == 2 * len(rows)
    clashing = docs.withColumns({"score": F.lit(1), "predicted": F.lit(2), "_label": F.lit(3), "_text": F.lit("x")})
    again = m.fit(clashing, labels)
    assert np.array_equal(again.weight, model.weight) and m.score(clashing, again).columns == ["doc_id", "score", "predicted"]
    none = m.fit(docs.limit(0), labels.limit(0))
    assert np.allclose(none.scores(next(iter(text_blocks(pa.array(["b", ""]))))), 0.5)


def test_quality_features_are_words_and_character_grams():
    """The features of each text, one at a time, are those of the whole block; grams are of code points."""
    texts = ["été à la plage", "", "日本語のテキスト", "aa aa b", "x", None]
    whole = m.features(next(iter(text_blocks(pa.array(texts)))))
    for i, text in enumerate(texts):
        alone = m.features(next(iter(text_blocks(pa.array([text, ""])))))
        for (b, lo, hi), (c, start, end) in zip(whole, alone):
            assert b[lo[i] : hi[i]].tolist() == c[start[0] : end[0]].tolist()
        sizes = [int(end[0] - start[0]) for _, start, end in alone]
        assert sizes == [len((text or "").split()), max(0, len(text or "") - 2), max(0, len(text or "") - 3)]


def test_quality_scores_against_a_loop():
    rng = np.random.Generator(np.random.PCG64(3))
    model = m.Model(rng.normal(0, 1, m._ECHO + 1).astype(np.float32), 0.25)
    texts = ["one two two é", "", "日本 語", "longer text with more words " * 40]
    block = next(iter(text_blocks(pa.array(texts))))
    got = model.scores(block)
    for i in range(len(texts)):
        buckets = [int(x) for b, lo, hi in m.features(block) for x in b[lo[i] : hi[i]]]
        logit = sum(float(model.weight[b]) for b in buckets) / max(1, len(buckets)) + 0.25
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-6


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item!"), (3, None), (4, "..."), (5, "one two three four five six seven eight nine ten"), (10, "short item")]


def bench_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in low).split(" ")


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", broadcast)
    texts = ODD + ["x One, two three four-five six seven eight nine ten! eleven y", "a short  ITEM b short item short item", "one two three four five six seven eight nine", "ten " + ITEMS[0][1] + " " + ITEMS[0][1], ITEMS[4][1]]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    windows = {}
    for i, t in ITEMS:
        w = [x for x in bench_words(t) if x]
        for k in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(i)
    got = {x.doc_id: x for x in d.judge(docs, bench).collect()}
    dirty = set()
    for i, t in enumerate(texts):
        w = [x for x in bench_words(t) if x]
        hit, items = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= found
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(map(str, items)))
        if hit:
            dirty.add(i)
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(len(texts))) - dirty
    cut = {x.doc_id: x.text for x in d.decontaminate(docs, bench, remove="spans").collect()}
    assert len(cut) == len(texts) and all(cut[i] == t for i, t in enumerate(texts) if i not in dirty)
    assert cut[len(ODD)] == "x y" and cut[len(ODD) + 1] == "a b "
    assert d.judge(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert d.judge(docs.limit(0), bench).count() == 0
    doubled = docs.union(docs)
    assert d.judge(doubled, bench).count() == 2 * len(texts)
    assert sorted((x.n_words, x.n_hit) for x in d.judge(doubled, bench).collect()) == sorted(2 * [(x.n_words, x.n_hit) for x in got.values()])
    assert d.decontaminate(doubled, bench).count() == 2 * (len(texts) - len(dirty))


def test_language_of_repeated_rows_and_clashing_names(spark):
    train = spark.createDataFrame([("en", "the cat and the dog " * 5, 1), ("de", "der hund und die katze " * 5, 2)], "lang string, text string, gram long")
    profiles = g.learn(train)
    docs = spark.createDataFrame([(1, "the dog and the cat " * 2000, "x", "y", "z")] * 2 + [(2, "der hund", "x", "y", "z")], "doc_id long, text string, lang_pred string, score string, _found string")
    got = sorted((x.doc_id, x.lang_pred) for x in g.identify(docs, profiles).collect())
    assert got == [(1, "en"), (1, "en"), (2, "de")]


def test_rules_of_no_rows_and_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "n_words", 5)] * 3 + [(None, None, "x", 6)], "doc_id long, text string, failed string, n_words int")
    got = r.ledger(r.measure(docs)).collect()
    assert sorted((x.doc_id or 0, x.n_words) for x in got) == [(0, 0), (1, 2), (1, 2), (1, 2)]
    assert r.measure(docs.limit(0)).count() == 0


def test_many_short_rows_in_a_block(spark):
    """More rows in one batch than row numbers of a block have room for."""
    texts = ["the"] * 70_000 + ["der hund"]
    profiles = g.learn(spark.createDataFrame([("en", "the the the"), ("de", "der hund der hund")], "lang string, text string"))
    blocks = list(text_blocks(pa.array(texts)))
    assert max(b.hi - b.lo for b in blocks) <= 1 << 15 and sum(b.hi - b.lo for b in blocks) == len(texts)
    far = np.concatenate([g.distances(b, profiles)[0] for b in blocks])
    assert (far[:-1, 1] < far[:-1, 0]).all() and far[-1, 0] < far[-1, 1]
