"""Sign hashes: every component counts, every vector can be a neighbour."""

from partwise.plans import catalogue as registry  # loads the modules of queries, in order


def test_last_signs_count_and_all_rows_are_candidates(spark):
    from partwise.plans import text

    assert "num_hamming_top" in registry.QUERIES
    plus = [1.0] * 64
    rows = [(0, plus), (50, plus[:63] + [-1.0]), (7, plus[:62] + [-1.0, -1.0]), *[(k, plus) for k in range(101, 121)]]
    got = {}
    for r in text.nearest_signs(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["a"], []).append((-r["similarity"], r["b"]))
    assert sorted(got[0]) == [(-1.0, k) for k in range(101, 111)]
    assert sorted(got[50]) == [(-63 / 64, k) for k in [0, 7, *range(101, 109)]]
    assert set(got) == {0, 50}


def test_blocks_against_all_pairs(spark, monkeypatch):
    import random

    from partwise.operators import hamming

    monkeypatch.setattr(hamming, "BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.getrandbits(64) - 2**63, 7, -1]), rng.getrandbits(3)) for i in range(200)] + [(None, 7, 7), (900, None, 1)]
    df = spark.createDataFrame(rows, "id long, x long, y long").repartition(5)
    got = {}
    for r in hamming.nearest_hashes(df.where("id % 20 = 0"), df, ["x", "y"], "id", 4).collect():
        got.setdefault((r.x, r.y), []).append((r.apart, r.other))
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    good = [r for r in rows if None not in r]
    want = {(x, y): sorted((bits(x, a) + bits(y, b), j) for j, a, b in good)[:4] for i, x, y in good if i % 20 == 0}
    assert {k: sorted(v) for k, v in got.items()} == want
