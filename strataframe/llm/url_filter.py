"""URL filters: host and path rules first, then segmented names and naive Bayes.

Concatenated names in hosts and paths are cut into words by the most likely
path through a unigram model (Viterbi).  A multinomial naive Bayes model over
those words learns from all distinct urls: those with a seed word in the host
count as blocked, the others as allowed.  So words that keep company with seed
words come to weigh as well.  Rules decide first and teach the model nothing,
since they are about sites, not about words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import lower_ascii
from .shared import written

#: Words of pages that occur in names of urls, up to which they are held in each task; more are joined.
BROADCAST_WORDS = 500_000
#: Short words are parts of many names: they are joined in so many shares.
SHARES = 32
#: Letters of the longest word that a name may be cut into.
LONGEST = 24
#: Distinct tokens up to which their weights are broadcast.
BROADCAST_TOKENS = 500_000
#: Words of host names that mark a url as an example of what to block.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "dating", "escort", "gambling", "hack", "jackpot", "loan", "loans",
    "lottery", "malware", "payday", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx",
)
_CACHE = 200_000
_NAME = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls (ties: the first given)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def counted_words(pages: DataFrame, text: str = "html") -> DataFrame:
    """(word, n) of all words of all pages, tags left out."""
    plain = F.lower(F.regexp_replace(F.col(text), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(plain, "[^\\p{L}]+")).alias("word")).filter(F.length("word").between(2, LONGEST))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_counts(pages: DataFrame, text: str = "html") -> dict[str, int]:
    """All words of pages that are few enough to collect."""
    return {r["word"]: r["n"] for r in counted_words(pages, text).collect()}


class Segmenter:
    """Cuts a name into words; a part that is no word costs more with each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total`` counts all words, if ``counts`` holds only those that names can have."""
        total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {word: -math.log(n / total) for word, n in counts.items()}
        self.unknown = math.log(total)
        self.seen: dict[str, list[str]] = {}

    def cut(self, name: str) -> list[str]:
        found = self.seen.get(name)
        if found is None:
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            found = self.seen[name] = self._cut(name)
        return found

    def _cut(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                price = self.cost.get(word, self.unknown + math.log(10) * len(word))
                options.append((best[start] + price, start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, text: str, kind: str) -> list[str]:
        """Words of a host or path; a number of any digits is one token by its length."""
        out = []
        for name in _NAME.findall(text.lower()):
            out += [f"{kind}#{len(name)}"] if name.isdigit() else [f"{kind}{word}" for word in self.cut(name)]
        return out


def url_tokens(urls: DataFrame, segmenter: Segmenter) -> DataFrame:
    """(host, path, tokens) of distinct (host, path)."""
    shared = urls.sparkSession.sparkContext.broadcast(segmenter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = shared.value
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            tokens = [segmenter.tokens(host, "h:") + segmenter.tokens(path, "p:") for host, path in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(tokens, pa.list_(pa.string()))], ["host", "path", "tokens"])

    return urls.select("host", "path").mapInArrow(run, "host string, path string, tokens array<string>")


def url_names(urls: DataFrame) -> DataFrame:
    """(host, path, at, kind, name) of all names and numbers of urls; one row with nulls if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = [(kind, name) for kind, text in (("h:", host), ("p:", path)) for name in _NAME.findall(text.lower())]
                rows += [(host, path, at, *x) for at, x in enumerate(found or [(None, None)])]
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["host", "path", "at", "kind", "name"])

    return urls.select("host", "path").mapInArrow(run, "host string, path string, at int, kind string, name string")


def name_parts(names: DataFrame) -> DataFrame:
    """(name, word) of all stretches of names that words could be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                words = sorted({name[i:j] for i in range(len(name)) for j in range(i + 2, min(len(name), i + LONGEST) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.string())], ["name", "word"])

    return names.select("name").mapInArrow(run, "name string, word string")


def joined_tokens(listed: DataFrame, names: DataFrame, known: DataFrame, seeds: dict[str, int], total: int) -> DataFrame:
    """The same as ``url_tokens`` if the words are too many for a task: each name meets its own by a join."""
    short = F.length("word") <= 4
    parts = name_parts(names).withColumn("share", F.when(short, F.pmod(F.hash("name"), F.lit(SHARES))).otherwise(0))
    shares = F.when(short, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    met = parts.join(known.withColumn("share", F.explode(shares)), ["word", "share"]).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column("name").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            cuts = [Segmenter(dict(counts or ()) | seeds, total).cut(name) for name, counts in found]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(cuts, pa.list_(pa.string()))], ["name", "words"])

    cut = names.join(met, "name", "left").mapInArrow(run, "name string, words array<string>")
    words = F.coalesce("words", F.when(F.col("name").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("#"), F.length("name").cast("string")))))
    each = listed.join(cut, "name", "left").select("host", "path", "at", F.transform(words, lambda w: F.concat("kind", w)).alias("words"))
    gathered = each.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    return gathered.select("host", "path", F.flatten("all.words").alias("tokens"))


def cut_urls(urls: DataFrame, counts: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """(host, path, tokens) of urls, by all words of ``counts`` (word, n) however many."""
    listed = url_names(urls)
    names = written(listed.filter("name is not null and not name rlike '^\\\\p{Nd}+$'").select("name").distinct(), "url-names")
    known = written(counts.join(name_parts(names).select("word").distinct(), "word", "left_semi"), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = {r["word"]: r["n"] for r in counts.filter(F.col("word").isin(*seeds)).collect()}
    raised = {seed: max(1, total // 10_000, found.get(seed, 0)) for seed in seeds}
    total += sum(n - found.get(seed, 0) for seed, n in raised.items())
    if known.count() > BROADCAST_WORDS:
        return joined_tokens(listed, names, known, raised, total)
    return url_tokens(urls, Segmenter({r["word"]: r["n"] for r in known.collect()} | raised, total))


def bayes_weights(labelled: DataFrame) -> tuple[DataFrame, float, float, int]:
    """(token, weight) from (tokens, blocked), the prior, an unseen token's weight, distinct tokens.

    A weight is the log of how much likelier a token is in blocked urls, add-one
    smoothed.  Without urls of both verdicts the prior alone decides.
    """
    tokens = labelled.select("blocked", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.sum(F.col("blocked").cast("long")).alias("b"), F.sum((~F.col("blocked")).cast("long")).alias("a"))
    urls = labelled.agg(F.sum(F.col("blocked").cast("long")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("v")).first()
    b, a, v = (total["b"] or 0), (total["a"] or 0), total["v"]
    blocked = urls["b"] or 0
    prior = math.log((blocked + 1) / (urls["n"] - blocked + 1))
    base = math.log(a + v + 1) - math.log(b + v + 1)
    return counts.select("token", (F.log(F.col("b") + 1) - F.log(F.col("a") + 1) + base).alias("weight")), prior, base, v


def with_seeds(counts: dict[str, int], seeds: tuple[str, ...]) -> dict[str, int]:
    """Counts in which each seed is at least as frequent as one word in ten thousand."""
    least = max(1, sum(counts.values()) // 10_000)
    return counts | {seed: max(least, counts.get(seed, 0)) for seed in seeds}


def judge(pages: DataFrame, rules: list[Rule], seeds: tuple[str, ...] = SEEDS, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, host, path, rule, verdict, score) of every page.

    ``verdict`` is the rule's, else ``block`` where the model's log odds are above
    zero, else ``allow``; ``score`` holds those log odds.  A null url or one
    without a scheme has empty host and path and is judged by the prior.
    Repeated pages are judged alike and all stay.  Log odds of exactly zero allow.  An
    empty table gives an empty one.  A very long name is cut in time in proportion to its
    length; a null page has no words.  Other columns, whatever their names, are not read.
    """
    pages = pages.select(page, url, html)
    host, path = split_url(F.col(url))
    parsed = pages.select(page, host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    # Each distinct address is cut and scored once, however many pages share it.
    urls = parsed.select("host", "path").distinct()
    counts = written(counted_words(pages, html), "page-words")
    tokens = written(cut_urls(urls, counts, seeds), "url-tokens").withColumn("rule", rule).withColumn("ruled", verdict)
    blocked = F.arrays_overlap("tokens", F.array(*[F.lit(f"h:{seed}") for seed in seeds]))
    weights, prior, unseen, distinct = bayes_weights(tokens.select("tokens", F.coalesce(blocked, F.lit(False)).alias("blocked")))
    if distinct <= BROADCAST_TOKENS:
        weights = F.broadcast(weights)
    each = tokens.select("host", "path", "rule", "ruled", F.explode_outer("tokens").alias("token"))
    weight = F.when(F.col("token").isNull(), 0.0).otherwise(F.coalesce("weight", F.lit(unseen)))
    scored = each.join(weights, "token", "left").groupBy("host", "path").agg(
        F.first("rule").alias("rule"), F.first("ruled").alias("ruled"), (F.round(F.sum(weight), 9) + F.lit(prior)).alias("score")
    )
    final = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return parsed.join(scored, ["host", "path"]).select(page, "host", "path", "rule", final.alias("verdict"), "score")
