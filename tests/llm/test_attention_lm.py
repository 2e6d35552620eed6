import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataframe.llm import attention_lm as a
from strataframe.llm.queries import tokenizer_file
from strataframe.llm.textarrays import text_blocks

VOCABULARY = tokenizer_file("byte_bpe_50k.json")
TEXTS = ["the cat sat on the mat", "The dog sat on a log", "", None, " \n", "zebra", "the " * 200, "der hund und die katze " * 30, "X", "the cat sat on the mat"]


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]


def coded(texts):
    return a.code_block(next(iter(text_blocks(pa.array(texts)))), VOCABULARY)


def plain_counts():
    """Every piece has a class by its id and none was ever seen."""
    size = a.pieces_of(VOCABULARY).size
    classes, nothing = 1 + np.arange(size) % (a.CLASSES - 1), np.zeros(0, np.int64)
    return a.Counts(0, 0, classes, classes, np.zeros(a.CLASSES, np.int64), np.zeros(a.CLASSES, np.int64), nothing, nothing, 1)


def lay(texts, scored=a.STRIDE):
    return a.lay_out(coded(texts), plain_counts(), scored)


def random_weights(seed, kind=np.float64):
    rng = np.random.Generator(np.random.PCG64(seed))
    return {k: rng.normal(0, 0.3, s).astype(kind) for k, s in a._SHAPES.items()}


def test_pieces_are_the_longest_of_the_vocabulary():
    import json

    vocabulary = json.load(open(VOCABULARY))["model"]["vocab"]
    texts = ["antidisestablishment the zqxj q", "was  running", "x"]
    c = coded(texts)
    at = 0
    for text in texts:
        for word in text.split():
            for n, found, part in ((k, ids, p) for k in range(1, a.PIECE_BYTES + 1) for ids, p in ((c.first, word[:k]), (c.last, word[-k:])) if k <= len(word)):
                numbers = [vocabulary[x] for x in (part, "\u0120" + part) if x in vocabulary]
                longest = max(k for k in range(1, a.PIECE_BYTES + 1) if k <= len(word) and any(x in vocabulary for p in ((word[:k],) if found is c.first else (word[-k:],)) for x in (p, "\u0120" + p)))
                if n == longest:
                    assert found[at] == min(numbers)
            at += 1


@pytest.mark.parametrize("held", [0, 4, 400_000])
def test_base_score_and_counts(spark, monkeypatch, held):
    monkeypatch.setattr(a, "HELD_WORDS", held)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n long, hash string").repartition(3)
    train = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r for r in a.score(df, df.filter(df.doc_id.isin(train)), VOCABULARY).collect()}
    counts = Counter(w for i in train for w in [*words(TEXTS[i]), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(TEXTS):
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert got[i].n_tokens == len(tokens) and got[i].train_tokens == n
        assert got[i].n_known == sum(counts[w] > 0 for w in tokens)
        assert abs(got[i].base_score - base) < 1e-6
        assert got[i].score < 0
    assert abs(got[0].score - got[9].score) < 1e-4


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = a.score(df, df.limit(0), VOCABULARY).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert a.score(df.limit(0), df, VOCABULARY).collect() == []


def naive_log(weights, first, last, target):
    """Natural log of P(classes) of one text, a token at a time."""
    total = 0.0
    for t in range(len(target)):
        begin = max(0, t // a.STRIDE * a.STRIDE - (a.CONTEXT - a.STRIDE))
        x = [weights["first"][first[j]] + weights["last"][last[j]] for j in range(begin, t + 1)]
        q = x[-1] @ weights["query"]
        scores = [q @ (v @ weights["key"]) / math.sqrt(a.WIDTH) + weights["distance"][t - begin - j] for j, v in enumerate(x)]
        shares = np.exp(scores) / np.exp(scores).sum()
        h = x[-1] + sum(p * (v @ weights["value"]) for p, v in zip(shares, x)) @ weights["mix"]
        group, place = divmod(int(target[t]), a.MEMBERS)
        for logits, k in ((h @ weights["out_group"] + weights["bias_group"][0], group), ((h + weights["told"][group]) @ weights["out_place"] + weights["bias_place"][group], place)):
            total += logits[k] - np.log(np.exp(logits).sum())
    return total


def test_scores_against_a_loop_over_tokens():
    texts = ["the cat sat on the mat", "", "der hund und die katze im haus " * 19, "one"]
    counts, c = plain_counts(), coded(["the cat sat on the mat", "", "der hund und die katze im haus " * 19, "one"])
    weights = random_weights(8)
    got = a.score_block(weights, c, counts, chunk=3)
    for i in range(len(texts)):
        lo, hi = c.words.bounds[i], c.words.bounds[i + 1]
        classes = counts.class_of[c.first[lo:hi]]
        naive = naive_log(weights, [0, *classes], [0, *counts.last_class_of[c.last[lo:hi]]], [*classes, 0])
        assert abs(got[i] - naive) < 1e-6


def test_whole_scores_against_counts_and_layer(spark, monkeypatch):
    """The score of a text is the layer's log of its classes and each word's share of its class."""
    kept = []
    real = a.train
    monkeypatch.setattr(a, "train", lambda docs, counts, *x: kept.append((counts, real(docs, counts, *x))) or kept[-1][1])
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "the cat"), (None, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = a.score(df, df, VOCABULARY).collect()
    assert len(got) == len(rows)
    counts, weights = kept[0]
    seen = Counter(w for _, t in rows for w in [*words(t), None])
    c = coded([t or "" for _, t in rows])
    class_of = dict(zip([w for _, t in rows for w in words(t)], counts.class_of[c.first].tolist())) | {None: 0}
    layer = a.score_block(weights, c, counts)
    want = []
    for (doc, t), log in zip(rows, layer):
        shares = [(seen[w] + 1) / (sum(n for x, n in seen.items() if class_of[x] == class_of[w]) + sum(class_of[x] == class_of[w] for x in seen) + 1) for w in [*words(t), None]]
        want.append((doc or -1, log / math.log(10) + sum(map(math.log10, shares))))
    found = sorted((-1 if r.doc_id is None else r.doc_id or -1, r.score) for r in got)
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-3 for x, y in zip(found, sorted(want)))


def test_windows_score_each_token_once_and_see_no_future():
    texts = ["a b c", "", "w1 w2 w3 w4 w5 " * 15]
    for places in (a.STRIDE, a.CONTEXT):
        laid = lay(texts, places)
        scored = laid.keys[:, a.CONTEXT - places :][~laid.unseen[:, a.CONTEXT - places :]]
        assert sorted(scored.tolist()) == list(range(len(laid.target)))
    weights = random_weights(1, np.float32)
    laid_all = a.forward(weights, lay(texts), slice(None))
    changed = a.forward(weights, lay(["a b zebra", "", "w1 w2 w3 w4 w5 " * 15]), slice(None))
    assert np.allclose(laid_all[0, :2], changed[0, :2]) and np.allclose(laid_all[1:], changed[1:], atol=1e-5)


@pytest.mark.parametrize("places", [a.STRIDE, a.CONTEXT])
def test_gradients_are_right(places):
    laid = lay(["a b c d e f", "the cat sat " * 20], places)
    weights, picked = random_weights(2), np.arange(len(laid.keys))
    g = a.gradients(weights, laid, picked)

    def loss(w):
        out = a.forward(w, laid, picked, keep=True)
        return -out[0].sum() / out[1].sum()

    for name in a._SHAPES:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[name][at]) < 1e-4 + 0.02 * abs(g[name][at])


def test_training_lowers_the_loss():
    laid = lay(["der hund und die katze im haus " * 10, "the cat and the dog in a house " * 10] * 20, a.CONTEXT)
    start = a.initial(plain_counts())
    learned, _ = a.train_on(start, [laid])
    before, after = (a.forward(w, laid, slice(None)).sum() for w in (start, learned))
    assert after > before * 0.6


def test_every_training_document_reaches_the_layer(spark):
    """What only documents of one remainder say is learned, whichever it is."""
    df = spark.range(640).selectExpr("id doc_id", "pmod(xxhash64(id), 32) part")
    start = a.initial(plain_counts())
    for part in (0, 9, 31):
        text = f"repeat(if(part = {part}, 'blue sky ', 'red sand '), 30) text"
        learned = a.train(df.selectExpr("doc_id", text).coalesce(1), plain_counts(), VOCABULARY)
        blue = lay(["blue sky blue sky blue sky"])
        assert a.forward(learned, blue, slice(None))[0, 3] > a.forward(start, blue, slice(None))[0, 3] + 3


def test_probabilities_of_all_classes_sum_to_one():
    weights = random_weights(4)
    text = lay(["the cat sat on"])
    total = 0.0
    for k in range(a.CLASSES):
        text.target[4] = k
        total += np.exp(a.forward(weights, text, slice(None))[0, 4])
    assert abs(total - 1) < 1e-9
