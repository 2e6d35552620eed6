import math
from collections import Counter

import pytest

from strataframe.llm import url_filter as u
from strataframe.llm.queries import URL_RULES

PAGES = [
    (1, "http://Blog.Casino-Win.example.net/fr/1?x=/es/", "<p>the cat sat on the mat</p>"),
    (2, "https://example.org", "cat win"),
    (3, "https://example.org/es/1", None),
    (4, "https://sub.example.org/en/12#a", ""),
    (5, "https://badexample.org/en/2", "x"),
    (6, "HTTP://a.com/de/", "x"),
    (7, "http://a.com/fr/de/", "x"),
    (8, None, "x"),
    (9, "no scheme", "x"),
    (10, "://", "x"),
    (11, "http://catmat.example.net?q", "the the"),
    (11, "http://catmat.example.net?q", "the the"),
    (12, "http://onlinecasino.net/", "online online win"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string").repartition(3)


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[:end]


def test_judge_against_brute_force(spark):
    got = u.judge(frame(spark), URL_RULES).collect()
    assert len(got) == len(PAGES)
    segmenter = u.Segmenter(u.with_seeds(u.word_counts(frame(spark)), u.SEEDS))
    addresses = sorted({parse(url) for _, url, _ in PAGES})
    tokens = {a: segmenter.tokens(a[0], "h:") + segmenter.tokens(a[1], "p:") for a in addresses}
    blocked = {a: any(f"h:{s}" in tokens[a] for s in u.SEEDS) for a in addresses}
    b, a = Counter(), Counter()
    for x in addresses:
        (b if blocked[x] else a).update(tokens[x])
    v, nb = len(set(b) | set(a)), sum(blocked.values())
    odds = {
        x: math.log((nb + 1) / (len(addresses) - nb + 1))
        + sum(math.log((b[t] + 1) / (sum(b.values()) + v + 1)) - math.log((a[t] + 1) / (sum(a.values()) + v + 1)) for t in tokens[x])
        for x in addresses
    }
    by_id = {r.page_id: r for r in got}
    for page, url, _ in PAGES:
        host, path = parse(url)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        row = by_id[page]
        assert (row.host, row.path, row.rule) == (host, path, rule and rule.text)
        assert abs(row.score - odds[host, path]) < 1e-6
        assert row.verdict == (rule.verdict if rule else "block" if odds[host, path] > 0 else "allow")
    assert by_id[1].verdict == "block" and by_id[12].verdict == "block" and by_id[11].verdict == "allow"


def test_segmentation():
    segmenter = u.Segmenter({"online": 5, "casino": 5, "on": 9, "line": 3})
    assert segmenter.cut("onlinecasino") == ["online", "casino"]
    assert segmenter.cut("") == []
    assert "".join(segmenter.cut("zzonline" * 20)) == "zzonline" * 20
    assert u.Segmenter({}).cut("abc") == ["abc"]


def test_empty_pages(spark):
    assert u.judge(frame(spark, []), URL_RULES).collect() == []


@pytest.mark.parametrize("held", [0, 500_000])
def test_all_words_of_large_pages_count(spark, monkeypatch, held):
    """More words of one frequency than any cap; 'alphabet' is no bet, 'downloads' no ads."""
    monkeypatch.setattr(u, "BROADCAST_WORDS", held)
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in f"{i:05}") for i in range(60_000)]
    rows = [(1, "http://alphabet.net/downloads/7", " ".join([*words, "alphabet", "downloads"])), (2, "http://bestcasino.net", "best"), (3, None, "")]
    got = {r.page_id: r for r in u.judge(frame(spark, rows), []).collect()}
    assert (got[1].verdict, got[2].verdict) == ("allow", "block")


def test_judged_alike_with_words_held_or_joined(spark, monkeypatch):
    held = sorted(u.judge(frame(spark), URL_RULES).collect())
    monkeypatch.setattr(u, "BROADCAST_WORDS", 0)
    assert sorted(u.judge(frame(spark), URL_RULES).collect()) == held


def test_segments_are_the_cheapest_of_all(spark):
    """Every way to cut short names, by price."""
    counts = {"cat": 9, "at": 20, "a": 30, "catm": 1, "mat": 4, "ma": 2, "tc": 1, "on": 3, "ton": 2}
    s = u.Segmenter(counts)

    def price(words):
        return sum(s.cost.get(w, s.unknown + math.log(10) * len(w)) for w in words)

    def ways(name):
        if not name:
            return [[]]
        return [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in ways(name[k:])]

    for name in ("catmat", "matcaton", "xyz", "a", "tcatonma", "onatcatm"):
        assert abs(price(s.cut(name)) - min(map(price, ways(name)))) < 1e-9 and "".join(s.cut(name)) == name


def test_no_pages_and_clashing_names(spark):
    assert u.judge(frame(spark, []), URL_RULES).collect() == []
    more = frame(spark).selectExpr("*", "'h' AS host", "'p' AS path", "1 AS n", "'w' AS word", "2 AS score")
    assert u.judge(more, URL_RULES).count() == len(PAGES)
