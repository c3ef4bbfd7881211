import math

from pyspark.sql import functions as F

from partwise.llm.common import read
from partwise.llm.queries import op2_pivot_top_k
from partwise.llm.topk import exact_top_k

SF = "/root/testdata/sf0.001"


def brute(rows, is_query, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in sorted(good):
        if is_query(i):
            asked.setdefault(i, v)
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, op2_pivot_top_k(spark, SF).collect())) == brute(rows, lambda i: i % 50 == 0)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (100, [1.0, 0.0, 0.0]), (7, [3e7, 1.0]), (8, []), (50, [0.5, -1.0]), (50, [None, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted(map(tuple, exact_top_k(df, F.col("id") % 50 == 0).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_blocks_and_empty(spark):
    df = read(spark, SF, "embeddings")
    one = exact_top_k(df, F.col("id") % 50 == 0)
    many = exact_top_k(df, F.col("id") % 50 == 0, block_bytes=1000, sample=8)
    assert sorted(one.collect()) == sorted(many.collect())
    assert exact_top_k(df.limit(0), F.lit(True)).count() == 0
