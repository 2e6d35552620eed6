import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.llm import packing, queries, records
from strataframe.llm.tokens import Encoder

TEXTS = [
    "plain words, here.\nand there", "", None, " lead", "trail ", "two  spaces", "tab\there \n\n new", "it's  I'll x", "É Ünï <|endoftext|> x",
    "a\x1cb c", "\n", "   ", "x \n y\n  z", "ΑΣ ΣΑΣ σ", "déjà ÉTÉ Straße, ÿ ŒUVRE naïve. µ ª ǅ İI ﬁ e\u0301a", "한국어 кириллица עברית", "日本 語テキスト", "word " * 3000, "1234 $$$ 5%", "a | b|c || d", "x\ny z\n\nw \n", "a b.\nC d\n e\tf g,\n\"H\" i\nj\nk, l\n m", "same", "same",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    encode = Encoder(queries.tokenizer_file(name))
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        whole = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, encode.dtype).tolist() for x in encode.encode(texts)] == whole


def test_a_word_is_learned_once_whatever_stands_behind_it():
    encode = Encoder(queries.tokenizer_file("byte_bpe_50k.json"))
    words = [f"{a}{b}word" for a in "abcdé" for b in "vwxyz"]
    marks = ["", ",", ".", "$$$", "!?", "-", "1", ")", "\n"]
    texts = ["".join(f" {w}{m}" for w in words) for m in marks] + ["".join(f" {w}{m}{w}" for w in words) for m in marks[1:6]]
    ids = encode.encode(texts)
    assert [np.frombuffer(x, encode.dtype).tolist() for x in ids] == [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    # With and without a space before them; marks, the text's end and the like are few.
    assert len({*encode.first.young, *encode.later.young}) < 2 * len(words) + 2 * len(marks)


def test_cuts_of_random_texts_give_the_ids_of_whole_texts():
    encode, draw = Encoder(queries.tokenizer_file("byte_bpe_50k.json")), np.random.default_rng(5)
    kinds = [" \n", " \t\r\v\f", "abXYé", "012", ".,$#_<|>", "'stdmrel", "ªºµ²¼ŒΣσжя", "\x1c\x1f\x85\xa0\u2003\u3000\u1680\u180e", "日한עⅧ½\u0301\u0345", "\0\x01\x7f😀\u1c89"]
    letters = [[c for k in draw.choice(len(kinds), draw.integers(1, 5), replace=False) for c in kinds[k]] for _ in range(3000)]
    texts = ["".join(draw.choice(x, draw.integers(0, 30))) for x in letters] + ["a  <|endoftext|> b", "<|endoftext|>", ""]
    whole = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encode.dtype).tolist() for x in encode.encode(texts)] == whole
    assert encode.encode([]) == []


def frame(spark, texts=TEXTS):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, key long").repartition(3)


def reference(name, end):
    encode = Encoder(queries.tokenizer_file(name))
    return {i: encode.tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for i, t in enumerate(TEXTS)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(spark):
    want, start = reference("word_bpe_49k.json", 1), 0
    got = {r.doc_id: r for r in records.round_trip(spark, frame(spark), queries.tokenizer_file("word_bpe_49k.json"), 1, digest=True).collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), crc(want[i]))
        start += len(want[i])
    assert len(got) == len(want)


def test_records_by_index_and_damage(spark, tmp_path):
    want = reference("word_bpe_49k.json", 1)
    files = records.write_records(frame(spark), f"file://{tmp_path}/r", queries.tokenizer_file("word_bpe_49k.json"), 1, file_bytes=200).collect()
    assert sum(f.n_docs for f in files) == len(TEXTS) and len(files) > 2
    found = {}
    for f in files:
        for i in want:
            try:
                found[i] = records.read_one(f.path, i).tolist()
            except KeyError:
                pass
    assert found == want
    data = bytearray(records.frame(b"payload"))
    assert bytes(records.unframe(memoryview(data), 0)[0]) == b"payload"
    data[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(data), 0)
    with pytest.raises(ValueError):
        records.unframe(memoryview(data[:-3]), 0)


def test_records_of_nothing_and_of_null_ids(spark):
    path = queries.tokenizer_file("word_bpe_49k.json")
    assert records.round_trip(spark, frame(spark, []), path, 1).count() == 0
    nameless = records.round_trip(spark, frame(spark).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))), path, 1).collect()
    assert [r.doc_id for r in sorted(nameless, key=lambda r: r.start)] == [None] * 4 + list(range(4, len(TEXTS)))


def test_packing_is_whole_and_gapless(spark):
    want = reference("byte_bpe_50k.json", 0)
    rows = packing.pack(frame(spark), queries.tokenizer_file("byte_bpe_50k.json"), length=64, with_ids=True).collect()
    ids, places = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids.setdefault(r.doc_id, [])) == r.start and len(piece) == r.length and crc(piece) == r.ids_crc32
        assert r.doc_tokens == len(want[r.doc_id])
        ids[r.doc_id] += piece
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert ids == want
    total = sum(map(len, want.values()))
    assert sorted(places) == list(range((total + 63) // 64))
    for k, spans in places.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 64 or k == max(places)
    assert packing.pack(frame(spark, []), queries.tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 4, indexing="ij"), -1).reshape(-1, 4)
    keys = packing.hilbert_keys(cells, bits=2)
    assert sorted(keys) == list(range(256))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert packing.padded_length(512) == 512 and packing.padded_length(700) == 1024


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    from strataframe.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 4000)
    encode = Encoder(queries.tokenizer_file("byte_bpe_50k.json"))
    texts = [f"word{i} number{i % 7}, and more{i}\nline{i}" for i in range(200)]
    for _ in range(2):
        for at in range(0, 200, 20):
            whole = [e.ids for e in encode.tokenizer.encode_batch(texts[at : at + 20], add_special_tokens=False)]
            assert [np.frombuffer(x, encode.dtype).tolist() for x in encode.encode(texts[at : at + 20])] == whole
        assert encode.first.size + encode.later.size <= 4000
    assert encode.later.old


def test_equal_texts_are_spread_along_the_curve_and_order_follows_it(spark):
    docs = frame(spark, ["same text again"] * 300 + [f"other words {i} here" for i in range(200)]).withColumn("offset", F.lit(1)).withColumn("_place", F.lit(2))
    keyed = packing._keys(docs, packing.curve_bounds(docs, 8), "doc_id", "text").collect()
    assert len({r.stretch for r in keyed if r.doc_id < 300}) > 1
    order = {r.doc_id: (r.key, r.doc_id) for r in keyed}
    rows = packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), length=32).collect()
    places = sorted((r.sequence_id, r.offset, r.doc_id, r.start) for r in rows)
    found = [doc for _, _, doc, start in places if start == 0]
    assert found == sorted(order, key=order.get) and len(found) == 500


def test_records_keep_repeated_and_lowest_ids(spark):
    lowest = -(1 << 63)
    docs = spark.createDataFrame([(lowest, "a b"), (None, "c"), (7, "x y z"), (7, "x y z"), (7, None)], "doc_id long, text string")
    got = records.round_trip(spark, docs, queries.tokenizer_file("word_bpe_49k.json"), 1).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, lowest), (False, 7), (False, 7), (False, 7), (True, 0)]


def test_records_are_read_in_a_task_a_file(spark, tmp_path):
    files = records.write_records(frame(spark), f"file://{tmp_path}/many", queries.tokenizer_file("word_bpe_49k.json"), 1, file_bytes=200)
    tasks = records.read_records(files).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == files.count() > 2
