"""Queries ``opN_<name>`` over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, decontaminate, hard_negatives, jaccard, language, line_dedup, packing, quality_model, quality_rules, records, resampling, suffix_dedup, url_filter
from .textarrays import crc32_mod

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_mod("doc_id", 5) == 0
    model = quality_model.fit(documents, labels.filter(~held_out))
    return quality_model.score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    profiles = language.learn(documents.filter(~held_out))
    return language.identify(documents, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


_OP4_SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
)
SELECT documents.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = documents.doc_id GROUP BY documents.doc_id
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, spans = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return words.join(spans, "doc", "left").select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.col("n_repeated").isNotNull().alias("has_repeats"),
        F.coalesce(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), F.array().cast("array<string>")).alias("spans"),
    )


_OP5_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
    SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), marks AS (
    SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lowest FROM k) WHERE doc_id > lowest
), islands AS (
    SELECT doc_id, i, sum((p IS NULL OR p + 50 < i)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM marks)
), spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, island),
found AS (SELECT doc_id, list(a || '-' || b ORDER BY a) AS spans, sum(b - a)::BIGINT AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, n IS NOT NULL AS has_repeats,
       coalesce(spans, []::VARCHAR[]) AS spans
FROM d LEFT JOIN found USING (doc_id)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.measure(table(spark, sf_dir, "documents"))
    base = quality_rules.policy_mask("base")
    return quality_rules.ledger(measured).select(
        "doc_id",
        *quality_rules.COUNTS[:5],
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        quality_rules.keeps("v1").alias("kept"),
        "failed",
        *quality_rules.COUNTS[5:],
    )


_OP6_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
           string_split(coalesce(text, ''), chr(10)) AS l
    FROM documents
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8
), keyed AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM windows
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS t(j) GROUP BY doc_id
), ll AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(l) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), echo AS (
    SELECT doc_id, count(*) AS n
    FROM (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM words) WHERE word = p GROUP BY doc_id
), m AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words,
           length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           coalesce(n_lines, 0)::BIGINT AS n_lines,
           length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, coalesce(echo.n, 0)::BIGINT AS n_echoes
    FROM d LEFT JOIN ll USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN echo USING (doc_id)
), bits AS (
    SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
        + 4 * (10 * n_symbols > 2 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
        + 16 * (100 * n_capitals > 30 * word_chars)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
        + 64 * (word_chars > 20 * n_words)::BIGINT + 128 * (100 * n_echoes > 30 * n_words)::BIGINT)::BIGINT AS failed
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed, n_lines, n_capitals, n_echoes
FROM bits
"""

def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.judge(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


_OP8_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range(0, 10) AS t(j) WHERE j < n GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 7) == 2
    scored = attention_lm.score(documents, documents.filter(~held_out), tokenizer_file("byte_bpe_50k.json"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return records.round_trip(spark, documents, tokenizer_file("word_bpe_49k.json"), end_id=1, digest=True)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")))


_OP12_SQL = """
WITH e AS (
    SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
           [floor(256 * x::DOUBLE) for x in embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, id, score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.clean_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP13_SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), k AS (
    SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


QUERIES: dict[str, Query] = {
    "op1_quality_model": op1_quality_model,
    "op2_language": op2_language,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_attention_lm": op9_attention_lm,
    "op10_token_records": op10_token_records,
    "op11_resampling": op11_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": _OP4_SQL,
    "op5_suffix_dedup": _OP5_SQL,
    "op6_quality_rules": _OP6_SQL,
    "op8_decontamination": _OP8_SQL,
    "op12_hard_negatives": _OP12_SQL,
    "op13_line_dedup": _OP13_SQL,
}
