import importlib
import random
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from strataframe.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = queries.table(spark, DIR, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = p.written(stage(spark, docs, DIR), "test-stage")
        assert out.columns == queries.table(spark, DIR, "documents").columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        before = {i: before[i] for i in ids}
        docs = out
    assert len(before) > 100
    assert queries.decontaminate.judge(docs, queries.table(spark, DIR, "benchmark")).filter("contaminated").count() == 0
    packed = p.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r.doc_id for r in packed} == set(before)
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) == (total + 1023) // 1024


def test_foreign_and_random_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (80, 300, 3000)]
    foreign = ["Съешь ещё этих мягких французских булок да выпей чаю", "Talo on suuri ja kissa istuu katolla, mutta koira juoksee metsässä koko päivän", "Dom jest duży, a kot siedzi na dachu, ale pies biegnie przez las cały dzień"]
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    kind = docs.schema["doc_id"].dataType
    more = spark.createDataFrame([(900_000_000 + i, t) for i, t in enumerate([*noise, *foreign])], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    kept = p.identify_language(spark, docs.unionByName(more, allowMissingColumns=True), "")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_all_stages_against_brute_force(spark, tmp_path):
    """Documents of two languages with copies, near copies, a shared passage, a leak and odd rows, by plain Python."""
    from test_jaccard import brute as components_of
    from test_suffix_dedup import brute as repeats_of
    from test_tokens import crc
    from tokenizers import Tokenizer

    rng = random.Random(12)
    english = "the house and tree river stone light water of in on with people small great over under morning evening green".split()
    german = "der die das haus und baum fluss stein licht wasser von mit menschen klein gross über unter morgen abend grün".split()
    texts = [(lang, " ".join(rng.choices(words, k=90))) for lang, words in (("en", english), ("de", german)) for _ in range(12)]
    passage = " ".join(rng.choices(english, k=60))
    texts += [("en", texts[0][1]), ("en", texts[1][1] + " more"), ("en", texts[2][1] + " " + passage), ("en", passage + " " + texts[3][1][::-1].replace("e", "a"))]
    leak = " ".join(f"{w}{k}" for k, w in enumerate(english[:12]))
    texts += [("en", texts[4][1][:200] + " " + leak), ("de", None), ("de", "123 456"), (None, "")]
    rows = [(i, t, lang, "src", len(t or ""), "extra") for i, (lang, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t/documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "t/benchmark.parquet"))
    folder = str(tmp_path / "t")
    kept = {r.doc_id: r for r in p.identify_language(spark, queries.table(spark, folder, "documents"), folder).collect()}
    assert all(kept[i].lang == lang for i, _, lang, *_ in rows if i in kept)
    assert {i for i, t, *_ in rows if not any(c.isalpha() for c in t or "")}.isdisjoint(kept) and len(kept) >= 26
    left = [(i, t) for i, t, *_ in rows if i in kept]
    left = [(i, t) for i, t in left if components_of(left)[i][1] == i]
    marked, cut = repeats_of(left), []
    for i, t in left:
        cut.append((i, " ".join(w for k, w in enumerate(t.split()) if k not in marked[i]) if marked[i] else t))
    clean = [(i, t) for i, t in cut if leak not in t]
    assert len(kept) > len(left) > len(clean) and any(marked.values())
    encode = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    ids, starts = {}, {}
    for r in sorted(p.run(spark, folder).collect(), key=lambda r: (r.doc_id, r.start)):
        whole = encode.encode(dict(clean)[r.doc_id], add_special_tokens=False).ids + [0]
        assert r.start == starts.get(r.doc_id, 0) and r.doc_tokens in (len(whole), len(whole) + 1)
        if not marked[r.doc_id]:
            assert r.ids_crc32 == crc(whole[r.start : r.start + r.length])
        starts[r.doc_id] = r.start + r.length
        ids[r.doc_id] = r.doc_tokens
    assert starts == ids and set(ids) == {i for i, _ in clean}


def test_stages_of_no_documents(spark, tmp_path):
    docs = queries.table(spark, DIR, "documents").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, docs, DIR).count() == 0, name


@pytest.mark.parametrize("missing", ["corpus_pipeline", "strataframe.llm"])
def test_entry_works_without(monkeypatch, missing):
    for name in list(sys.modules):
        if name.startswith(("strataframe.llm", "corpus_pipeline", "__spark_entry__")):
            monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == missing or name.startswith(missing + "."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" not in names and "surface_area_stats" in names
    assert any(n.startswith("op") for n in names) == (missing == "corpus_pipeline")
    for name in list(sys.modules):
        if name.startswith("__spark_entry__"):
            del sys.modules[name]
