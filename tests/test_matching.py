"""Queries meet all records but their own; a folder is listed whole."""

import os

from pyspark.sql import functions as F

from partwise.plans import catalogue as registry  # loads the modules of queries, in order


def test_queries_match_each_other_but_not_themselves(spark):
    from partwise.plans import aggregates

    parts = spark.createDataFrame([(k, "blue ring", "Brand#1", "LARGE") for k in (50, 51, 100)], "p_partkey long, p_name string, p_brand string, p_type string")
    want = {(50, 51), (50, 100), (100, 50), (100, 51)}
    assert {(r["p_partkey"], r["rec"]) for r in aggregates.most_shared(parts, 50).collect()} == want


def test_every_rule_of_the_matcher_fires(spark):
    from partwise.operators import matching as m
    from partwise.plans import matching

    rows = matching.scored(spark, "/root/testdata/sf0.01").select("given.rule", "relation", "decision", "basis").distinct().collect()
    assert {x for r in rows for x in r["rule"]} == set(m.WEIGHTS) - {"generic", "unproven"}  # generic hits go before they are scored; every key of a page is one of its own terms
    assert {r["relation"] for r in rows} == {"connector", "exact_component", "main_integrated_circuit", "onboard_component", "functional_equivalent"}
    assert {r["decision"] for r in rows} == {"auto_accepted", "review", "rejected"} and {r["basis"] for r in rows} == set(m.BASES)


def test_generic_names(spark):
    from partwise.operators import matching as m

    rows = [("R", True), ("Conn_01x04", True), ("Connector_Generic_2", True), ("LED RED", True), ("Rotary", False), ("BME280", False)]
    got = spark.createDataFrame(rows, "s string, want boolean").select(m.is_generic(F.col("s")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_a_folder_is_listed_whole(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["name"]: r["length"] for r in registry.QUERIES["src_local_dir"](spark, folder).select("name", "length").collect()}
    assert got == {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".parquet")}


def test_files_are_digested_in_pieces(spark, tmp_path):
    """Files longer than ``binaryFile`` takes, split nowhere; odd ones with and without marks at their ends."""
    import hashlib
    import random

    mark, order, some = b"\x15", b"\xef\xbb\xbf", random.Random(5).randbytes(300_000)
    found = [mark, mark * 3, b"x", order, order + mark, order + b"text", b"PAR1", b"PAR1" + some + b"PAR1", b"PAR1" + some + mark, some, order + some + mark, b"line\r\nline\n", b"\0" * 200_000]
    files = {f"f{n}.parquet": data for n, data in enumerate(found)} | {"a b+%20é{1}.parquet": b"name", "table.parquet/part-0.parquet": some[:5000], "table.parquet/part-1.parquet": some[5000:]}
    (tmp_path / "table.parquet").mkdir()
    for name, data in (files | {"other.txt": some, "empty.parquet": b""}).items():  # Spark's sources list no empty files
        (tmp_path / name).write_bytes(data)
    for key, value in (("spark.sql.sources.binaryFile.maxLength", "1000"), ("spark.sql.files.maxPartitionBytes", "20000")):
        spark.conf.set(key, value)
    try:
        got = {r["name"]: (r["length"], r["sha"]) for r in registry.QUERIES["src_local_dir"](spark, str(tmp_path)).collect()}
    finally:
        for key in ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(key)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}


def test_records_compete_for_pages(spark):
    """Pages without a hit, with one, and with more than are kept; two accepted records block a page."""
    from partwise.plans import matching, quality

    sf = "/root/testdata/sf0.01"
    counts = {r["query"]: r["n"] for r in matching.scored(spark, sf).groupBy("query").agg(F.count("*").alias("n")).collect()}
    pages = spark.read.parquet(f"{sf}/part.parquet").count()
    assert max(counts.values()) == 100 and sum(n == 100 for n in counts.values()) > 100 and any(n == 1 for n in counts.values()) and len(counts) < pages
    twice = {r["p_partkey"] for r in quality.facts(spark, sf).where("n_accepted > 1").collect()}
    assert twice and not {r["p_partkey"] for r in quality.evaluated(spark, sf).where("route <> 'reject'").collect()} & twice


def lookup_by_definition(queries, index, limit):
    from collections import Counter

    bases, out = ["exact", "alias", "name", "description"], []
    for q in {q for q, _, _ in queries}:
        best, shared = {}, Counter(r for a, b, k in queries if a == q and b == "description" for b2, k2, r in index if b2 == b and k2 == k)
        near = sorted(shared, key=lambda r: (-shared[r], r))[:limit]
        for a, b, k in queries:
            for b2, k2, r in index:
                if a == q and b == b2 and k == k2 and (b != "description" or r in near):
                    best[r] = min(best.get(r, 9), bases.index(b))
        out += [(q, r, bases[n]) for n, r in sorted((n, r) for r, n in best.items())[:limit]]
    return sorted(out)


def test_capped_lookups_against_the_definition(spark):
    import random

    from partwise.operators import matching as m

    rng = random.Random(6)
    bases = {"exact": 40, "alias": 6, "name": 4, "description": 7}
    index = {(b, f"{b[0]}{rng.randint(0, n)}", r) for b, n in bases.items() for r in range(80) for _ in range(2)} | {("name", "n0", r) for r in range(80)}
    queries = {(q, b, f"{b[0]}{rng.randint(0, n + 2)}") for b, n in bases.items() for q in range(30) for _ in range(rng.randint(0, 3))}
    i = spark.createDataFrame(sorted(index), "basis string, key string, record long")
    q = spark.createDataFrame(sorted(queries), "record long, basis string, key string")
    for limit in (3, 10, 200):
        assert sorted(map(tuple, m.lookups(q, "query", i, limit).collect())) == lookup_by_definition(sorted(queries), sorted(index), limit)


def test_keys_and_records_that_many_have_are_dealt_out(spark, monkeypatch):
    """Keys of many askers go over blocks, records of many pages come by broadcast: the same hits, each once."""
    from partwise.operators import matching as m

    monkeypatch.setattr(m, "SPREAD", 5)
    monkeypatch.setattr(m, "HOT", 5)
    queries = [(q, b, k) for q in range(40) for b, k in (("alias", "kit"), ("exact", f"e{q}"), ("description", "sensor"), ("description", f"d{q % 3}"))]
    index = [(b, k, r) for r in range(25) for b, k in (("alias", "kit" if r % 2 else "other"), ("exact", f"e{r}"), ("description", "sensor"), ("description", f"d{r % 4}"))]
    i, q = spark.createDataFrame(index, "basis string, key string, record long"), spark.createDataFrame([(a, b, k) for a, b, k in queries], "record long, basis string, key string")
    for limit in (4, 30):
        lists = m.listed(q, "query", i, limit)
        want = lookup_by_definition(queries, index, limit)
        assert sorted((r["query"], h["record"], h["basis"]) for r in lists.collect() for h in r["hits"]) == want
        pages, known = spark.range(40).select(F.col("id").alias("query"), (F.col("id") * 2).alias("page")), spark.range(25).select(F.col("id").alias("record"), (F.col("id") * 3).alias("symbol"))
        got = m.paired(lists, pages, known, "query").select("query", "record", "basis", "page", "symbol").collect()
        assert sorted(map(tuple, got)) == [(a, r, b, a * 2, r * 3) for a, r, b in want]


def test_dimensions_of_the_page_alone_match_nothing(spark, monkeypatch):
    from partwise.operators import quality
    from partwise.plans import matching

    def refuse(*_):
        raise AssertionError("matched")

    monkeypatch.setattr(matching, "scored", refuse)
    for name in [*(f"q_{n}" for n in quality.UNMATCHED), "q_expectations", "q_evidence_match"]:
        registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
