import math
from collections import Counter

import numpy as np
import pytest

from partwise.llm import lm
from partwise.llm.common import read
from partwise.llm.queries import op5_context_tree_score

from helpers import awkward, crc_mod, empty, words

SF = "/root/testdata/sf0.001"


def base(rows):
    learn = lambda i: i is None or crc_mod(i, 7) != 2
    texts = [(i, [*words(t), None]) for i, t in rows]
    c = Counter(w for i, ws in texts if learn(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, not learn(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in texts]


def tree_scores(rows):
    """The same model from dictionaries: counts by context and prefix, mixed from the root down."""
    learn = lambda i: i is None or crc_mod(i, 7) != 2
    streams = [(i, b"\0" * (lm.DEPTH - 1) + b" " + b"".join(w.encode() + b" " for w in words(t)) + lm.END) for i, t in rows]
    counts: dict = {}

    def steps(stream):
        for at in range(lm.DEPTH, len(stream)):
            for bit in range(8):
                prefix = (1 << bit) | (stream[at] >> (8 - bit))
                yield stream[at - lm.DEPTH : at], prefix, (stream[at] >> (7 - bit)) & 1

    for i, s in streams:
        if learn(i):
            for context, prefix, bit in steps(s):
                for d in range(lm.DEPTH + 1):
                    counts.setdefault((context[lm.DEPTH - d :], prefix), [0, 0])[bit] += 1
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    below: dict = Counter()
    weighted = {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        weighted[k] = own[k] if len(k[0]) == lm.DEPTH else np.logaddexp(own[k], below[k]) - math.log(2)
        if k[0]:
            below[(k[0][1:], k[1])] += weighted[k]
    out = []
    for _, s in streams:
        total = 0.0
        for context, prefix, bit in steps(s):
            p = None
            for d in range(lm.DEPTH, -1, -1):
                k = (context[lm.DEPTH - d :], prefix)
                n = counts.get(k, (0, 0))
                kt = (n[bit] + 0.5) / (sum(n) + 1)
                if p is not None:
                    w = 1 / (1 + math.exp(-min(700, max(-700, own[k] - below[k]))))
                    p = w * kt + (1 - w) * p
                elif sum(n):
                    p = kt
            total += math.log10(p if p is not None else 0.5)
        out.append(total)
    return out


def same(got, rows):
    got = sorted(map(tuple, got), key=repr)
    want = sorted(((*b, s) for b, s in zip(base(rows), tree_scores(rows))), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:7] == pytest.approx(w[5:], rel=1e-5)
    sizes = sorted((i, -s * math.log2(10) / (sum(len(x.encode()) + 1 for x in words(t)) + 1)) for (i, t), s in zip(rows, tree_scores(rows)) if i is not None)
    assert sorted((g[0], g[7]) for g in got if g[0] is not None) == [(i, pytest.approx(b, rel=1e-5)) for i, b in sizes]


def test_query_base_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    got = {r["doc_id"]: r for r in op5_context_tree_score(spark, SF).collect()}
    for i, held, n, known, total, score in base(rows):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(score)
        assert r["score"] < 0


def test_tree_against_dictionaries(spark):
    docs = awkward(spark).where("doc_id is null or doc_id <> 7")
    same(lm.scored(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_long_texts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_CHARS", 50_000)
    docs = awkward(spark)
    a = sorted(map(tuple, lm.scored(docs).collect()), key=repr)
    monkeypatch.setattr(lm, "CHUNK_CHARS", 10_000_000)
    b = sorted(map(tuple, lm.scored(docs).collect()), key=repr)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5:] for x in a], [x[5:] for x in b])


def test_empty_and_unlearned(spark):
    assert lm.scored(empty(spark)).count() == 0
    held = next(i for i in range(100) if crc_mod(i, 7) == 2)
    row = lm.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)
    assert row["score"] == pytest.approx(-8 * 5 * math.log10(2))


def test_probabilities_of_a_byte_sum_to_one():
    texts = [[b"abra", b"cadabra"], [b"abba"]]
    grams, _ = lm.grams_of(texts)
    keys = np.unique(grams)
    context = int(keys[3]) >> 8 << 8
    every = np.unique(np.concatenate((keys, np.array([context | b for b in range(256)], dtype=np.uint64))))
    n = np.zeros(len(every))
    np.add.at(n, np.searchsorted(every, grams), 1)
    tree = lm.Subtrees(every, n)
    p = 10 ** tree.log10_probability(every, lm.Top(list(zip(*tree.top()))))
    assert p[(every >> np.uint64(8)) == np.uint64(context >> 8)].sum() == pytest.approx(1)
    assert np.array_equal(lm.unpacked(lm.packed(every)), every)


def test_report_rows_grow_with_the_input(spark, monkeypatch):
    """Twice the text makes twice the chunks and about twice the rows, not four times."""
    import random

    monkeypatch.setattr(lm, "CHUNK_CHARS", 6_000)
    monkeypatch.setattr(lm, "SLOTS", 16)
    rng, rows, kept = random.Random(1), {}, lm.stored

    def counted(df, name):
        out = kept(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lm, "stored", counted)
    for n in (400, 800):
        docs = spark.createDataFrame([(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))) for i in range(n)], "doc_id long, text string")
        assert lm.scored(docs).count() == n
    assert rows["lm-counts"][1] <= 2.3 * rows["lm-counts"][0]


def test_batches_hot_pairs_and_repeated_rows(spark, monkeypatch):
    """Many groups, batches and sums of sums give the scores of one; a text of one pair of bytes and a row repeated are like any other."""
    docs = spark.createDataFrame([(i, "ab" * (i % 40) + f" ab {i % 5}") for i in range(120)] + [(7, "same words again")] * 200, "doc_id long, text string").repartition(3)
    docs = kept_table(docs)
    want = sorted(map(tuple, lm.scored(docs).collect()), key=repr)
    for name, value in (("CHUNK_CHARS", 300), ("SLOTS", 8), ("GROUP_KEYS", 100), ("BATCH", 2), ("FAN", 2)):
        monkeypatch.setattr(lm, name, value)
    got = sorted(map(tuple, lm.scored(docs).collect()), key=repr)
    assert len(got) == len(want)
    assert all(a[:5] == b[:5] and all(abs(x - y) <= 1e-4 * (1 + abs(y)) for x, y in zip(a[5:], b[5:])) for a, b in zip(got, want))


def kept_table(df):
    from partwise.llm.common import stored

    return stored(df, "lm-test")
