"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become a hash set of normalised word windows.  Every window of
every document is probed against it inside one scan; a hit is verified word by
word; then the hit words, or their documents, can be taken out.  Each document
leaves the scan as one row plus one row per hit, so the shuffle is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_WORDS = 10
#: Rows of windows up to which the benchmark is broadcast; beyond it the join shuffles.
BROADCAST_WINDOWS = 1_000_000

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A word and what follows it, in a text whose capitals are still there.
_WORD_AND_GAP = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; plain ASCII texts take the fast built-in way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The normalised words; empty for a null or empty text."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(length)])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", length: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows (``h``, ``window``, ``items``) of all items.

    An item of fewer than ``length`` words is one window; without words it has none.
    """
    words = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.lit(length), F.size("words"))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("start")
    windows = words.select("item", "words", size.alias("size"), starts).select("item", F.slice("words", F.col("start"), F.col("size")).alias("window"))
    # A null leaves xxhash64 as it is, so a short window hashes like its words alone.
    h = _window_hash(F.col("window"), F.lit(0), length)
    return windows.groupBy("window").agg(F.collect_set("item").alias("items")).select(h.alias("h"), "window", "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", length: int = WINDOW_WORDS) -> DataFrame:
    """Rows (doc, row, text_key, n_words, start, size, items): one for every window of a
    document that the benchmark holds, and at least one, if with null ``start``.

    ``row`` tells apart rows that share an id.  A null id is a value like others.
    """
    windows = benchmark_windows(benchmark, item, "text", length)
    sizes = windows.select(F.size("window").alias("n")).agg(F.collect_set("n").alias("sizes"), F.count(F.lit(1)).alias("rows")).first()
    # A row's number hangs on its file and place alone, so that a task that runs again gives the same.
    parsed = docs.select(F.col(doc), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_key"), words_of(F.col(text)).alias("words"))
    keys = [doc, "row", "text_key"]
    # One row per word, made, hashed and probed within one stage of generated
    # code: the array of words is only referred to, never copied.
    at_word = parsed.select(*keys, "words", F.posexplode_outer("words").alias("at", "word"))
    n_words = F.size("words")
    lengths = sorted(sizes.sizes) or [length]
    hashes = [F.when(F.col("at") + n <= n_words, _window_hash(F.col("words"), F.col("at"), n)) for n in lengths]
    if len(hashes) == 1:
        probed = at_word.withColumn("h", hashes[0])
    else:
        probed = at_word.withColumn("h", F.explode_outer(F.array(*hashes)))
    size = F.size("window")
    real = F.slice("words", F.col("at") + 1, F.greatest(F.lit(1), size)) == F.col("window")
    if sizes.rows <= BROADCAST_WINDOWS:
        joined = probed.join(F.broadcast(windows), "h", "left")
    else:
        # Only places and hashes move; the few that meet a window go back to their texts.
        met = probed.filter(F.col("h").isNotNull()).select(F.col(doc).alias("_doc"), F.col("text_key").alias("_key"), "at", "h").join(windows, "h")
        met = met.select("_doc", "_key", "at", "window", "items").dropDuplicates(["_doc", "_key", "at", "window"])
        joined = parsed.join(met, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left").drop("_doc", "_key")
    start = F.when(F.col("window").isNotNull() & real, F.col("at"))
    # The first word's row stays without a hit, so that every document has a row.
    found = joined.withColumn("start", start)
    if sizes.rows <= BROADCAST_WINDOWS:
        found = found.filter(F.col("at").isNull() | (F.col("at") == 0) | F.col("start").isNotNull())
    hit = F.col("start").isNotNull()
    return found.select(*keys, n_words.cast("long").alias("n_words"), "start", F.when(hit, size).alias("size"), F.when(hit, F.col("items")).alias("items"))


def judge(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", length: int = WINDOW_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted as strings), spans, contaminated, and text_key.

    ``spans`` are hit word ranges (start, end), in order and possibly overlapping.
    Rows that share an id, repeated ones too, are judged each for itself.  Null and empty
    texts have no words, on either side; an empty benchmark hits nothing and an empty
    table of documents gives no rows.  A very long text is probed window by window in one
    task.  Other columns, whatever their names, are not read.
    """
    hits = find_hits(docs.select(doc, text), benchmark.select(item, F.col("text")), doc, text, item, length)
    keys = [doc, "row", "text_key"]
    by_doc = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_first(), "size")
    end = F.col("start") + F.col("size")
    reached = F.max(end).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    merged = hits.withColumn("new", F.when(F.col("start").isNotNull(), new).otherwise(0))
    strings = F.transform(F.array_distinct(F.flatten(F.collect_list("items"))), lambda x: x.cast("string"))
    span = F.when(F.col("start").isNotNull(), F.struct(F.col("start"), end.alias("end")))
    return merged.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"),
        F.sum("new").cast("long").alias("n_hit"),
        F.array_sort(strings).alias("items"),
        F.array_sort(F.collect_set(span)).alias("spans"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", doc: str = "doc_id", text: str = "text", item: str = "item_id", length: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without contaminated documents, or without the words that were hit.

    With ``remove="spans"`` a hit word goes with the separators after it; other
    documents keep their text as it is.  Clean rows stay, repeated ones too.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    bad = judge(docs, benchmark, doc, text, item, length).filter("contaminated").select(F.col(doc).alias("__sf_doc"), F.col("text_key").alias("__sf_key"), F.col("spans").alias("__sf_spans"))
    bad = bad.dropDuplicates(["__sf_doc", "__sf_key"])
    same = F.col(doc).eqNullSafe(F.col("__sf_doc")) & (F.xxhash64(text) == F.col("__sf_key"))
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    pieces = F.regexp_extract_all(F.col(text), F.lit(_WORD_AND_GAP), F.lit(0))
    head = F.regexp_extract(F.col(text), "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    kept = F.filter(pieces, lambda x, i: ~F.exists("__sf_spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    cleaned = F.when(F.col("__sf_spans").isNotNull(), F.concat(head, F.array_join(kept, ""))).otherwise(F.col(text))
    return docs.join(bad, same, "left").withColumn(text, cleaned).select(*docs.columns)
