import hashlib
import math

import numpy as np
import pytest

from partwise.llm.centroids import Centroids, clustered
from partwise.llm.common import read
from partwise.llm.queries import op11_centroid_clusters

SF = "/root/testdata/sf0.001"


def brute(rows, k=8, rounds=10, size=64, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(mine[n]) for x in zip(*mine[n])] if n in mine else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    most = 2**63 - 1
    of = {n: sum(min(d, most) for _, m, d in found if m == n) for n in range(len(centroids))}
    return sorted(((i, n, min(d, most), min(of[n], most), min(sum(of.values()), most), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_against_brute_force(spark):
    assert got(op11_centroid_clusters(spark, SF)) == brute([(r["vec_id"], r["embedding"]) for r in read(spark, SF, "embeddings").collect()])


@pytest.mark.parametrize("big", [1.0, 3e7, 1e200])
def test_awkward_vectors(spark, big):
    """Nulls, other lengths, ties, repeats, empty clusters, components beyond 31 and 64 bits."""
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (None, [0.5, 0.5]), (6, [1.0]), (7, []), (8, [-0.0001, 0.0001]), (9, [-3.3, 1 / 3]), (10, [big, -big]), (11, [big, 1.0]), (12, [big, -big]), (13, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int, x string")
    for k in (1, 3, 30):
        assert got(clustered(df, k=k, size=2)) == brute(rows, k=k, size=2)
    assert got(clustered(df.limit(0))) == []
    assert got(clustered(df, size=5)) == []


def test_overlapping_intervals_are_decided_exactly():
    """Centroids nearer to each other than float32 can tell, and equal ones."""
    rng = np.random.default_rng(3)
    for spread in (1, 1000, 2**26, 2**40):
        base = rng.integers(-spread * 50, spread * 50 + 1, 64)
        centroids = [[int(v) for v in base + rng.integers(-1, 2, 64)] for _ in range(12)]
        centroids += [centroids[3], [int(v) for v in -base]]
        x = base + rng.integers(-1, 2, (300, 64))
        own = Centroids(centroids)
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))[1] for v in x]
        assert own.nearest(x.astype(np.int64)).tolist() == want
        assert own.nearest(x.astype(np.int64), at_once=20).tolist() == want
        assert own.shortlist(x)[np.arange(300), want].all()
    easy = Centroids([[0] * 64, [1000] * 64])
    assert (easy.shortlist(rng.integers(0, 100, (50, 64))).sum(axis=1) == 1).all()
