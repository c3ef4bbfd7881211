"""Word similarity in one sweep; the stored indexes are read in part."""

import random
import time

from pyspark.sql import functions as F

from partwise.functions import rank
from partwise.operators import postings
from partwise.plans import catalogue, search

SF = "/root/testdata/sf0.01"


def every_stretch(own, seq):
    best = 0.0
    for a in range(len(seq)):
        for b in range(a, len(seq)):
            part = set(seq[a : b + 1])
            best = max(best, len(own & part) / len(own | part))
    return best


def test_sweep_against_every_stretch():
    rng = random.Random(1)
    for _ in range(400):
        own = {rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))}
        seq = [rng.choice("abcdefghijklmnop"[: rng.choice([4, 8, 16])]) for _ in range(rng.randint(0, 25))]
        assert rank.best_stretch(own, seq) == every_stretch(own, seq)


def test_long_texts_take_a_second():
    rng = random.Random(2)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz"):
        seq = ["".join(rng.choice(alphabet) for _ in range(3)) for _ in range(100_000)]
        began = time.perf_counter()
        assert rank.best_stretch({"aba", "bab", "aab", "zzz", "xyz"}, seq) > 0
        assert time.perf_counter() - began < 2


def test_only_the_postings_of_the_needle_are_read(spark):
    index = search.token_index(spark, SF)
    some = postings.of_terms(index, search.NEEDLE)
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "In(term" in plan
    assert 0 < some.count() < index.count() / 5
    assert len(set(some.inputFiles())) >= 1
    files = lambda df: {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files(some)) < len(files(index)) / 5


def test_index_gives_the_rows_of_a_scan(spark):
    docs = search.search_documents(spark, SF)
    want = {r.p_partkey for r in docs.where(rank.matches_all(F.col("tokens"), search.NEEDLE)).select("p_partkey").collect()}
    assert {r.p_partkey for r in catalogue.QUERIES["fts_match"](spark, SF).collect()} == want and want
