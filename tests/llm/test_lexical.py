import math
import re
from collections import Counter

import pytest
from helpers import ASCII_LOWER, awkward, empty
from pyspark.sql import functions as F

from partwise.llm import lexical
from partwise.llm.common import read

SF = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def brute(docs, items, k=20):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    full = [d for d in own if d[2]]
    n_docs, n_terms, df = len(full), sum(d[2] for d in full), Counter(t for d in full for t in d[1])
    texts, out = {}, []
    for i, t in items:
        if t is not None:
            texts[i] = min(t, texts.get(i, t))
    for item, text in texts.items():
        found = []
        for i, counts, n in full:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if t in counts)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_small_chunks_against_brute_force(spark, monkeypatch):
    """Many chunks and blocks, with few documents each."""
    monkeypatch.setattr(lexical, "CHUNK_DOCS", 7)
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    items = read(spark, "/root/testdata/sf0.001", "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(lexical.ranked(docs, items)) == want
    assert got(lexical.ranked(docs, items, block_terms=400)) == want
    assert got(lexical.ranked(docs, items, k=3)) == [r for r in want if r[1] <= 3]


def test_awkward_rows(spark):
    more = [(20, "Cat", "en", "a"), (21, "cat", "en", "a"), (22, "ÉTÉ été cat-dog", "fr", "a"), (None, "cat", "en", "a"), (23, "x1 y2 x1", "en", "a"), (24, "naïve Straße 東京", "de", "a")]
    docs = awkward(spark, more)
    items = spark.createDataFrame([(1, "the CAT and the dog", "z"), (1, "zzz", "z"), (2, None, "z"), (3, "", "z"), (4, "nothing-here", "z"), (None, "été", "z"), (5, "long long", "z"), (6, "X1 straße 東京 a", "z")], "item_id long, text string, rank string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(lexical.ranked(docs, items)) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert got(lexical.ranked(docs, items, k=2)) == brute(rows, [(r.item_id, r.text) for r in items.collect()], k=2)
    assert got(lexical.ranked(empty(spark), items)) == []
    assert got(lexical.ranked(docs, items.limit(0))) == []


def test_many_equal_documents_go_by_id(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("red green blue")).otherwise(F.concat(F.lit("red w"), F.col("id"))).alias("text"))
    items = spark.createDataFrame([(1, "blue red"), (2, "w7 w8 red")], "item_id long, text string")
    assert got(lexical.ranked(docs, items, k=5)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "blue red"), (2, "w7 w8 red")], k=5)


def test_texts_are_tallied_in_stretches(monkeypatch):
    text = ("Ab-cd éf " * 50 + "x" * 300 + " ab").encode()
    want = lexical.tallied(text, {b"ab": 0, "éf".encode(): 1, b"x" * 300: 2})
    monkeypatch.setattr(lexical, "STRETCH", 16)
    assert lexical.tallied(text, {b"ab": 0, "éf".encode(): 1, b"x" * 300: 2}) == want == (152, {0: 51, 1: 50, 2: 1})
    assert lexical.tallied(b"", {}) == (0, {})


def test_lists_are_fetched_in_part(spark):
    """The uniform threshold leaves most entries of frequent lists where they are."""
    docs = read(spark, SF, "documents").select("doc_id", "text")
    n_docs, n_terms = lexical.counts_of(docs)
    assert n_docs == sum(bool(terms(r.text)) for r in docs.collect()) and n_terms == sum(len(terms(r.text)) for r in docs.collect())
    assert lexical.Asked([(0, "a", 5), (0, "b", 1)]).bounded({0: 21}, {"a": 9, "b": 9}).cuts() == {"a": 3, "b": 11}
    assert lexical.Asked([(0, "a", 5)]).bounded({}, {"a": 9}).cuts() == {"a": 1}


@pytest.mark.parametrize("text", ["a" * 10, "1234 ab,cd"])
def test_native_and_byte_terms_agree(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(lexical.terms_of(F.col("text")).alias("t"))
    assert df.first().t == terms(text)
    assert lexical.tallied(text.encode(), {})[0] == len(terms(text))
