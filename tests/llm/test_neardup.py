import random
from collections import Counter, defaultdict

import numpy as np

from partwise.llm import neardup
from partwise.llm.common import read
from partwise.llm.queries import op7_setsketch_near_duplicates

from helpers import awkward, empty, words

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Rows by number; ids may repeat or be null."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                at[x].append(i)
    for ids in at.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else least[root(i)]
        out.append((d, len(sets[i]), c, d is None or c == d))
    return sorted(out, key=repr)


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=repr) == brute(rows)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    same(op7_setsketch_near_duplicates(spark, SF), rows)


def family(seed, n, change, length=120):
    """A chain of texts, each with a few words of the one before replaced."""
    rng = random.Random(seed)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        out.append(" ".join(w))
        w = list(w)
        for _ in range(change):
            w[rng.randrange(length)] = f"w{rng.randint(0, 10**6)}"
    return out


def test_chains_stars_and_borders(spark):
    texts = [t for seed, change in enumerate((1, 2, 3, 4, 5)) for t in family(seed, 40, change)]
    base = family(99, 1, 0)[0].split()
    rng = random.Random(5)
    for _ in range(150):  # one hot group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w))
    texts += ["  ".join(base).upper()] * 30
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PICK_ROWS", 1)
    rows = list(enumerate(family(7, 60, 3) + family(8, 60, 4)))
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    same(neardup.near_duplicates(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 7, 8, 9, 10, None], key=repr)


def test_empty(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 100))
    x, y = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
    sx, sy = neardup.set_sketch(x), neardup.set_sketch(y)
    assert np.array_equal(neardup.merge_sketches(sx, sy), neardup.set_sketch(np.union1d(x, y)))
    guess = neardup.jaccard_estimate(np.array([(sx > sy).sum()]), np.array([(sx < sy).sum()]), np.array([800.0]), np.array([700.0]))
    assert abs(guess[0] - 600 / 900) < 0.15


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 20)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 230)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and {got[i] for i in range(100, 160)} == {100} and {got[i] for i in range(200, 231)} == {200}


def test_every_text_of_an_id_is_judged_alone(spark):
    a, b, x, y = (family(s, 1, 0, 30)[0] for s in (1, 2, 3, 4))
    rows = [(1, a), (5, a), (5, b), (7, x), (7, y), (7, y), (7, None), (9, " "), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, neardup.deduplicated(docs).collect()))
    assert got == Counter({(1, a): 1, (5, b): 1, (7, x): 1, (7, y): 1, (7, None): 1, (9, " "): 1, (None, a): 2})


def test_large_groups_meet_their_first_member(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = family(6, 60, 3) + family(7, 30, 1) + [family(8, 1, 0)[0]] * 40
    rows = [(i, t) for i, t in enumerate(texts)]
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)
