"""Verdicts against direct matching, collisions, segments and odd rows."""
import numpy as np

from sparkgauge.llm import url_filter
from sparkgauge.llm.queries import URL_RULES

URLS = [None, "", "example.com/en/", "http://Example.COM/en/x", "https://a.b.example.com/en/?q#f", "http://example.com", "http://com/", "x://notexample.com/fr/1",
        "http://www.example.com/en/1", "ftp://a.net/es/", "ftp://a.net/es", "http://user@a.net:80/fr/", "http://a.net?x/es/", "://net/fr/é", "http://.net/es/", "a://b://com/"]


def direct(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in URL_RULES for h in [r.split("/")[0]] if (host == h or host.endswith("." + h)) and path.startswith(r[len(h):])]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_against_direct_matching(spark):
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0], (None, "block")], "rule string, verdict string")
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS * 2)], "page_id int, url string, rule string, host int").repartition(2)
    for segment in (url_filter.SEGMENT_RULES, 2):
        got = url_filter.judge(pages, url_filter.build_index(rules, segment_rules=segment)).collect()
        assert len(got) == 2 * len(URLS)
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == direct(r["url"])
    assert url_filter.judge(pages.limit(0), url_filter.build_index(rules)).count() == 0
    nothing = url_filter.build_index(rules.limit(0))
    assert {r["verdict"] for r in url_filter.judge(pages, nothing).collect()} == {"allow"}


def test_equal_digests_are_told_apart_by_the_strings():
    segment = object.__new__(url_filter.Segment)
    segment.keys = np.array([5, 5, 9], np.uint64)
    texts = [b"a/", b"b/", b"c/"]
    segment.ends, segment.texts = np.array([0, 2, 4, 6], np.uint64), np.frombuffer(b"".join(texts), np.uint8)
    assert segment.find(np.array([5, 5, 5, 9, 1, 10], np.uint64), [b"b/", b"a/", b"x/", b"c/", b"a/", b"c/"]).tolist() == [1, 0, -1, 2, -1, -1]


def test_hosts_of_very_many_labels(spark):
    """Only the last labels are joined, whatever the length of the host; a rule of many labels is still found."""
    many = ".".join(["a"] * 40) + ".org"
    rules = spark.createDataFrame([*URL_RULES, (f"{many}/x/", "block"), (f"{many}/x/" + "y" * 3000, "allow")], "rule string, verdict string")
    index = url_filter.build_index(rules, segment_rules=3)
    assert len(index.names) > 1 and max(index.shapes) == (41, 3003)
    urls = [f"http://{'q.' * 100_000}example.com/en/1", f"http://{many}/x/1", f"http://b.{many}/x/{'y' * 5000}", "http://" + "." * 100_000 + "/x/", f"http://a{many}/x/1"]
    got = {r["i"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), index).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: (f"{many}/x/", "block"), 2: (f"{many}/x/" + "y" * 3000, "allow"), 3: (None, "allow"), 4: (None, "allow")}
    total = sum(len(s) for s, _ in url_filter.candidates("q." * 100_000 + "com", b"/x", index.shapes))
    assert total < 10_000


def test_many_rules_in_segments(spark):
    rules = spark.range(3000).selectExpr("concat('h', id % 700, '.example', id % 13, '.com/p', id, '/') AS rule", "CASE WHEN id % 2 = 0 THEN 'block' ELSE 'allow' END AS verdict")
    index = url_filter.build_index(rules, segment_rules=400)
    assert 6 <= len(index.names) <= 10
    pages = rules.selectExpr("concat('https://www.', rule, 'q?x') AS url", "rule AS want", "verdict AS wanted")
    got = url_filter.judge(pages, index)
    assert got.filter("rule = want AND verdict = wanted").count() == 3000
