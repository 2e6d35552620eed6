import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataframe.llm import packing, tokens
from strataframe.llm import suffix_dedup as s
from strataframe.llm.queries import tokenizer_file


def brute(rows):
    lowest = {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append("".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" "))
    texts = {i: [[w for w in t if w] for t in ts] for i, ts in texts.items()}
    for i in sorted(texts):
        for w in texts[i]:
            for k in range(len(w) - 49):
                lowest.setdefault(tuple(w[k : k + 50]), i)
    marked = {i: set() for i in texts}
    for i, ts in texts.items():
        for w in ts:
            for k in range(len(w) - 49):
                if lowest[tuple(w[k : k + 50])] < i:
                    marked[i].update(range(k, k + 50))
    return marked


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [rng.choices(vocabulary, k=rng.choice([49, 50, 51, 70, 130])) for _ in range(6)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 3)):
            words += rng.choices(vocabulary, k=rng.randint(0, 40))
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edited"
            words += p[rng.randint(0, 3) :]
        rows.append(" ".join(words))
    rows += ["", None, "  \n ", "same " * 120, "same " * 90, "é " * 60, "a b\t" * 400]
    rows += rows[:5]
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, start int").repartition(5)


def test_spans_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        words, spans = s.repeated_spans(frame(spark, rows))
        want = brute(rows)
        got = {r.doc: {k for x in r.spans for k in range(x.start, x.end)} for r in spans.collect()}
        assert got == {i: m for i, m in want.items() if m}
        assert words.count() == len(rows)


def test_removal_keeps_rows_and_other_texts(spark):
    rows = corpus(3) + [(None, "same " * 90)]
    df = frame(spark, rows)
    out = s.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want, got = brute([r for r in rows if r[0] is not None]), {r.doc_id: r.text for r in out.collect()}
    for i, t in rows:
        if not want.get(i):
            assert got[i] == t
        else:
            words = t.split()
            assert (got[i] or "").split() == [w for k, w in enumerate(words) if k not in want[i]]


def test_rows_of_one_id_and_nothing(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text), (1, text), (2, "x " + text), (2, "short")]
    _, spans = s.repeated_spans(frame(spark, rows))
    assert {r.doc: [tuple(x) for x in r.spans] for r in spans.collect()} == {2: [(1, 81)]}
    words, spans = s.repeated_spans(frame(spark, []))
    assert words.count() == 0 and spans.count() == 0


def test_lowest_within():
    rng = np.random.Generator(np.random.PCG64(0))
    for width in (1, 2, 5, 26):
        values = rng.integers(0, 20, 60).astype(np.uint64)
        want = [k + int(np.argmin(values[k : k + width])) for k in range(60 - width + 1)]
        assert s.lowest_within(values, width).tolist() == want


def test_groups_of_a_hot_anchor_go_by_windows(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_ROWS", 2)
    rows = corpus(5)
    _, spans = s.repeated_spans(frame(spark, rows))
    got = {r.doc: {k for x in r.spans for k in range(x.start, x.end)} for r in spans.collect()}
    assert got == {i: m for i, m in brute(rows).items() if m}


def test_batches_of_sorted_suffixes(spark, monkeypatch):
    monkeypatch.setattr(s, "ROWS_AT_ONCE", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = corpus(6, 25)
        _, spans = s.repeated_spans(frame(spark, rows))
        got = {r.doc: {k for x in r.spans for k in range(x.start, x.end)} for r in spans.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: m for i, m in brute(rows).items() if m}


def test_matches_are_extended_both_ways():
    """Three suffixes of one anchor: the second shares 3 words to the left and 24 to the right with the first."""
    rng = np.random.Generator(np.random.PCG64(2))
    right = np.tile(rng.integers(1, 1 << 60, 25, dtype=np.uint64), (3, 1))
    left = np.tile(rng.integers(1, 1 << 60, 25, dtype=np.uint64), (3, 1))
    right[1, 24:], left[1, 3:] = 5, 6
    right[2, 10:], left[2, 10:] = 7, 8
    order = np.lexsort(tuple(right.T[::-1]))
    doc, full = np.array([1, 2, 3])[order], np.full(3, 26)
    rows, first, last = s.extended(np.zeros(3, np.int64), right[order], left[order], doc, full, np.full(3, 25))
    assert [(doc[r], f, l) for r, f, l in zip(rows, first, last)] == [(2, 22, 24)]


def test_long_patterned_words_have_hashes_of_their_own():
    pattern = "a"
    while len(pattern) < 4096:
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    import pyarrow as pa

    from strataframe.llm.textarrays import find_words, range_hashes, text_blocks

    block = next(iter(text_blocks(pa.array([pattern + " " + pattern.translate(str.maketrans("ab", "ba"))]))))
    words = find_words(block)
    one, other = range_hashes(block.data, words.starts, words.ends)
    assert one != other


def test_tasks_give_memory_back(spark, monkeypatch):
    """All of the passages' steps in Python are made lean, those of a hot anchor too."""
    made, lean = [], s.lean
    monkeypatch.setattr(s, "lean", lambda run: made.append(run.__qualname__.split(".")[0]) or lean(run))
    monkeypatch.setattr(s, "HOT_ROWS", 1)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([f"a{k}", *words, f"b{k}"])) for k in range(3)]
    got = {r.doc_id: r.text for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: "a1 b1", 2: "a2 b2"}
    assert set(made) == {"_scan", "_of_parts", "neighbour_marks", "remove_repeats"}


def test_passages_drop_what_other_steps_kept_in_their_workers(spark):
    """A worker that packed texts goes on without the tokenizer and its pieces once it looks for passages."""
    docs = spark.createDataFrame([(k, f"some text {k}") for k in range(16)], "doc_id long, text string").repartition(8).cache()

    def held(batches):
        from strataframe.llm import tokens

        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x) for x in batches)]), pa.array([len(tokens._encoders)])], ["n", "held"])

    def most():
        return docs.mapInArrow(held, "n long, held long").agg(F.max("held")).first()[0]

    packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=False).count()
    s._scan(docs, "doc_id", "text").count()
    tokens.encoder(tokenizer_file("byte_bpe_50k.json"))
    assert list(s.lean(lambda batches: batches)(iter([1]))) == [1]
    assert not tokens._encoders and most() == 0


def test_suffixes_leave_a_task_in_parts(monkeypatch):
    monkeypatch.setattr(s, "BATCH_ROWS", 3)
    numbers = np.arange(8)
    parts = list(s._slices(s._batch(s._SUFFIXES, numbers, numbers, numbers, numbers, numbers, numbers)))
    assert [x.num_rows for x in parts] == [3, 3, 2]
    assert [x for part in parts for x in part.column("doc").to_pylist()] == numbers.tolist()
