import random

import pytest

from partwise.llm import urls
from partwise.llm.common import read
from partwise.llm.queries import op12_url_filter

FIXED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    tail = rest[len(host) :]
    ends = [tail.find(c) for c in "?#" if c in tail]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[: min(ends)] if ends else tail


def judge(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if None not in (h, p, v) and not set(h) & set("/?#") and url is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


AWKWARD = [
    None, "", "no scheme", "http://", "://", "http://ORG/", "http://a.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/12", "https://example.org/en/2", "https://notexample.org/es/", "http://example.org",
    "http://example.org?x=/es/", "http://example.org#/es/", "http://example.org:80/es/", "http://example.org./es/", "http://a..org/", "http://.org/", "http://x.com/fr", "http://x.com/fr/", "http://x.com/DE/", "http://x.com/de/://y.org/es/",
    "http://ÉXAMPLE.org/es/ü", "http://x.org/\n/es", "http://x.com/de/" + "a/" * 200_000, "http://" + "a." * 5_000 + "com/fr/x", "http://x.com/fr/", "http://x.com/fr/",
]


def test_awkward_urls(spark):
    pages = spark.createDataFrame([(i, u, "c", "v", 1, "r") for i, u in enumerate(AWKWARD)] + [(None, "http://b.com/de/", "c", "v", 1, "r")], "page_id long, url string, host string, verdict string, blocks int, row string")
    got = urls.judged(pages, urls.rule_table(spark))
    assert set(got.columns) == {"page_id", "url", "blocks", "row", "host", "path", "rule", "verdict"}
    have = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.blocks, r.row) for r in got.collect()), key=repr)
    assert have == sorted(((i, *judge(u, FIXED), 1, "r") for i, u in [*enumerate(AWKWARD), (None, "http://b.com/de/")]), key=repr)
    assert urls.judged(pages.limit(0), urls.rule_table(spark)).count() == 0
    bare = urls.judged(pages, urls.rule_table(spark).limit(0), default="block")
    assert {(r.rule, r.verdict) for r in bare.collect()} == {(None, "block")}


@pytest.mark.parametrize("setting", ["broadcast", "shuffled", "all shapes"])
def test_random_rules_against_brute_force(spark, monkeypatch, setting):
    if setting == "shuffled":
        monkeypatch.setattr(urls, "BROADCAST_RULES", 3)
    if setting == "all shapes":
        monkeypatch.setattr(urls, "SHAPES", 2)
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))
    rules = [(host(), rng.choice(["", path()]), rng.choice(["allow", "block"])) for _ in range(60)] + [("a", "/x", "allow"), ("a", "/x", "block"), (None, "/", "block"), ("a", None, "block"), ("b", "/", None), ("a/b", "/", "block"), ("a", "b", "block")]
    asked = [f"http://{host()}{rng.choice(['', path()])}{rng.choice(['', '?q', '#f'])}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    got = urls.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judge(u, rules) for u in asked]


def test_short_prefixes_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(urls, "PREFIX", 1)  # nearly every expression meets some rule
    pages = spark.createDataFrame(list(enumerate(AWKWARD)), "page_id long, url string")
    assert [(r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, urls.rule_table(spark)).orderBy("page_id").collect()] == [judge(u, FIXED) for u in AWKWARD]


def test_query_against_brute_force_and_no_python(spark):
    sf = "/root/testdata/sf0.01"
    df = op12_url_filter(spark, sf)
    got = sorted(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == sorted((r.page_id, *judge(r.url, FIXED)) for r in read(spark, sf, "pages").collect())
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
