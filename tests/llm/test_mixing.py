import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from partwise.llm import mixing
from partwise.llm.common import read
from partwise.llm.mixing import keyed, mixed_documents, mixed_report, targets, text_quality
from partwise.llm.queries import op1_mix_sources

from helpers import awkward, empty, words

SF = "/root/testdata/sf0.001"


def filled(sizes: dict) -> dict:
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        if not free:
            return out
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def check(docs, rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    source = defaultdict(list)
    for d in docs:
        source[d["doc_id"]].append((d["source"], len(words(d["text"]))))
        sizes[d["source"]] += len(words(d["text"]))
        largest[d["source"]] = max(largest[d["source"]], len(words(d["text"])))
    want = filled(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        (s, n), *_ = [x for x in source[r["doc_id"]] if x[1] == r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, n, 2 * n)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_query_against_plain_version(spark):
    rows = op1_mix_sources(spark, SF).collect()
    check(read(spark, SF, "documents").collect(), rows)
    assert sorted(rows) == sorted(op1_mix_sources(spark, SF).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs.collect(), mixed_report(docs, F.lit(None).cast("double")).collect())
    copies = mixed_documents(docs, text_quality(F.col("text")))
    assert copies.columns == docs.columns


def test_empty(spark):
    assert mixed_report(empty(spark), F.lit(1.0)).count() == 0


def brute(docs, quality, seed=17):
    """Which documents are taken how often: keys sorted within the source, whole epochs first, then up to the boundary nearest to the rest."""
    sizes, by_source = defaultdict(int), defaultdict(list)
    for d in docs:
        n = len(words(d["text"]))
        sizes[d["source"]] += n
        mark = hashlib.md5("\x1f".join((str(seed), "\0" if d["doc_id"] is None else str(d["doc_id"]), "\0" if d["text"] is None else d["text"])).encode()).hexdigest()
        key = -math.log((int(mark[:12], 16) + 1) / 2.0**48) / quality(d)
        by_source[d["source"]].append((key, -1 if d["doc_id"] is None else d["doc_id"], mark, n))
    out = []
    for s, target in filled(sizes).items():
        epochs = math.floor(target / sizes[s] + 1e-12) if sizes[s] else 0
        rest, upto, best = target - epochs * sizes[s], 0, (abs(target - epochs * sizes[s]), 0, None)
        rows = sorted(by_source[s])
        for i, (*where, n) in enumerate(rows):
            upto += n
            if i + 1 == len(rows) or rows[i + 1][:3] != tuple(where):
                best = min(best, (abs(upto - rest), upto, tuple(where)), key=lambda x: x[:2])
        for *where, n in rows:
            more = rest > 1e-9 and best[2] is not None and tuple(where) <= best[2]
            out.append((None if where[1] < 0 else where[1], n * (epochs + more)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weight", [0.1, 1.0, 1e4])
def test_chosen_keys_against_brute_force(spark, monkeypatch, weight):
    monkeypatch.setattr(mixing, "RANGES", 4)
    monkeypatch.setattr(mixing, "LAST", 5)
    docs = read(spark, SF, "documents")
    got = mixed_report(docs, F.lit(weight)).collect()
    assert sorted(((r["doc_id"], r["taken"]) for r in got), key=repr) == brute(docs.collect(), lambda d: weight)


def test_targets_fill_up(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 100), ("c", 1000), (None, 3)])], "doc_id long, text string, source string")
    got = {r["_mix_source"]: r["target"] for r in targets(keyed(docs, "doc_id", "text", "source", F.lit(1.0), 1), (5, 2, 1), 1.5, 2.0).collect()}
    want = filled({"a": 1, "b": 100, "c": 1000, None: 3})
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n", [1000, 10_000])
def test_cut_among_equal_rows(spark, n):
    """One row repeated: as many of it are taken as come nearest to the target."""
    rows = [(1, "a b c d e f g h i", "a")] * n + [(k, f"x y {k}", "b") for k in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixed_report(docs, F.lit(None).cast("double")).collect()
    check(docs.collect(), got)
    one = [r for r in got if r["doc_id"] == 1]
    assert abs(sum(r["taken"] for r in one) - one[0]["target"]) <= 9 and len({r["taken"] for r in one}) == 2
    copies = mixed_documents(docs, F.lit(None).cast("double")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: 9 * r["count"] for r in copies}[1] == sum(r["taken"] for r in one)
