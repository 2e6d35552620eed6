"""A corpus pipeline: five stages from raw documents to packed sequences.

Each stage works on what the one before it wrote; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontaminate, jaccard, language, packing, suffix_dedup
from strataframe.llm.queries import table, tokenizer_file
from strataframe.llm.shared import written

#: A text's language is doubtful below this share of the second nearest distance, which is 0.5 for a tie.
LEAST_MARGIN = 0.505
#: Share of a language's own texts that tells its reach, and how far beyond that a text may lie.
REACH_SHARE, REACH_SLACK = 0.99, 1.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found and sets ``lang`` to it.

    Profiles are learned from all rows with a language.  Texts that are null or
    without letters go, and so do those about as near to a second language and
    those farther from the nearest than its own texts are.  ``text`` and ``lang`` must be
    there; a null ``lang`` teaches nothing.  Repeated rows are judged alike and all stay or
    go; an empty table stays empty; a very long text is read whole.
    """
    predict = language.predictor(language.learn(docs))
    near = F.lit(False)
    for lang, reach in language.reaches(docs, predict, REACH_SHARE).items():
        near = near | ((F.col("__sf_found.lang_pred") == lang) & (F.col("__sf_found.far") <= reach * REACH_SLACK))
    found = docs.withColumn("__sf_found", predict(F.col("text")))
    kept = found.filter((F.col("__sf_found.lang_pred") != language.UNKNOWN) & (F.col("__sf_found.score") >= LEAST_MARGIN) & near)
    return kept.withColumn("lang", F.col("__sf_found.lang_pred")).select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of lowest id of each group of near copies."""
    return jaccard.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document of lower id holds, and corrects ``n_chars``."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids along a Hilbert curve."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Rank-order profiles and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
