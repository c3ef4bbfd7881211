import hashlib
import random
import re

import numpy as np

from partwise.llm import decontam
from partwise.llm.common import read
from partwise.llm.queries import op6_fm_decontaminate

from helpers import ASCII_LOWER, awkward, empty

SF = "/root/testdata/sf0.001"
KEPT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return KEPT.findall((text or "").translate(ASCII_LOWER))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    found |= got
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["_found_n_words"], r["_found_n_hit"], r["_found_items"]) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute(docs, items)]
    assert sorted(map(tuple, op6_fm_decontaminate(spark, SF).collect()), key=repr) == want
    assert any(w[2] for w in want)


def test_awkward_rows_short_items_and_blocks(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "Cat sat!"), (2, None), (None, "the mat and looked at the door the cat sat on the mat"), (3, ""), (3, "long"), (4, "der Hund und die Katze im Haus am See")], "item_id long, text string")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    one = decontam.find_benchmark(docs, items)
    assert one.columns[: len(docs.columns)] == docs.columns
    assert found(one) == want
    assert found(decontam.find_benchmark(docs, items, block_chars=20)) == want
    spans = [(x["start"], x["end"]) for r in one.collect() for x in r["_found_spans"]]
    assert sum(b - a for a, b in spans) == sum(w[2] for w in want)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert found(decontam.find_benchmark(awkward(spark), items)) == brute([(r["doc_id"], r["text"]) for r in awkward(spark).collect()], [])
    assert decontam.find_benchmark(empty(spark), items).count() == 0


def test_index_against_scan():
    rng = random.Random(3)
    for _ in range(30):
        runs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 8))]
        text = np.array([x for r in runs for x in [0, *r]] + [0])
        index = decontam.FMIndex(text, 4)
        phrases = [[rng.randint(1, 3) for _ in range(rng.randint(1, 5))] for _ in range(20)]
        padded = np.array([[0] * (5 - len(p)) + p for p in phrases])
        low, high = index.search(padded, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_long_and_repeated_items_go_in_bounded_blocks(spark, monkeypatch):
    """One item repeated and one longer than a block: no block holds more than its bound allows."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3)))
    long = [word() for _ in range(3000)]
    items = [(1, "x y z " * 5)] * 500 + [(2, " ".join(long)), (2, " ".join(long)), (3, "only four words here"), (4, None), (5, "")]
    docs = [(i, " ".join(long[i * 37 : i * 37 + 15]) + " and " + " ".join(long[-12:])) for i in range(60)] + [(90, "x y z " * 3), (91, "Only FOUR words here"), (92, " ".join(long[i] for i in range(9)))]
    sizes, own = [], decontam._pass

    def counted(rows, at, phrases, first):
        sizes.append(len(phrases.sizes))
        return own(rows, at, phrases, first)

    monkeypatch.setattr(decontam, "_pass", counted)
    got = decontam.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=1000)
    assert found(got) == brute(docs, items)
    assert len(sizes) > 5 and max(sizes) < 1200  # of 3,000 windows
