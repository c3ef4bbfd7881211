"""Contracts on small inputs: metrics, text keys, quantities, streams, S-expressions."""

import pytest
from pyspark.sql import functions as F

from partwise.functions import text as fn
from partwise.operators import lifecycle, metrics
from partwise.sources import sexpr


def test_rate_interval_contract(spark):
    row = spark.range(1).select(*[v.alias(k) for k, v in metrics.rate(F.lit(2), F.lit(3)).items()]).first()
    assert (row["estimate"], row["lower"], row["upper"]) == (667, 208, 939)
    none = spark.range(1).select(*[v.alias(k) for k, v in metrics.rate(F.lit(0), F.lit(0)).items()]).first()
    assert tuple(none) == (None, None, None)


def test_text_keys(spark):
    df = spark.createDataFrame([("  Straße-12 ",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(fn.search_key("t"), fn.identity_key(F.col("t")), fn.words_key(F.col("t")), fn.compact_key(F.col("t")), fn.code_suffix(F.col("t"))).collect()]
    assert got[0] == ("strasse-12", "strasse12", "strasse 12", "strae12", "stra_e_12")
    assert got[1] == ("", None, "", "", "unknown")
    assert got[2][1:3] == (None, "")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("3.30 to 5.0 Volts", ("range", "3.3", "5", "V")), ("10 ± 0.50 mm", ("tolerance", "10", "0.5", "mm")), ("+20mA", ("scalar", "20", None, "mA")), ("red", None)],
)
def test_quantity(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(fn.quantity(F.col("t")).alias("q")).first()["q"]
    assert (tuple(got) if got else None) == want


def test_throttle_fold(spark):
    rows = [("a", [0, 10, 20, 30, 40, 50]), ("b", [0, 950]), ("c", [])]
    got = {r["k"]: tuple(r["s"]) for r in spark.createDataFrame(rows, "k string, t array<bigint>").select("k", lifecycle.throttle_fold(F.col("t")).alias("s")).collect()}
    assert got == {"a": (0, 6, 950, 2), "b": (950, 1, None, 0), "c": (None, 0, None, 0)}


def test_sexpr_limits_and_symbols():
    assert sexpr.tree('(a "b\\"c" (d))') == [["a", 'b"c', ["d"]]]
    with pytest.raises(ValueError, match="too_deep"):
        sexpr.tree("(" * 200)
    with pytest.raises(ValueError, match="unbalanced"):
        sexpr.tree("(a")
    assert sexpr._rows("p", b"(x (symbol")[0][-1] == "unbalanced"


def test_stream_matches_batch(spark, tmp_path):
    from partwise.streaming import logs

    schema = "event_id long, ts timestamp, user_id long, event_type string"
    rows = [(i, 1_000_000 + 100 * i, i % 3, "error" if i % 2 else "view") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = logs.event_stream(spark, str(tmp_path / "in"), schema)
    run = logs.latest_state(stream, "user_id", "event_id", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    run.processAllAvailable()
    run.stop()
    want = lifecycle.latest(df, "user_id", ["event_id"], ["event_id", "event_type"])
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, want.collect()))

    run = logs.throttle_states(stream.where("event_type = 'error'"), "user_id", "ts").writeStream.outputMode("update").format("memory").queryName("throttle").start()
    run.processAllAvailable()
    run.stop()
    batch = lifecycle.throttled(df.where("event_type = 'error'"), "user_id", F.unix_seconds("ts"))
    assert sorted(map(tuple, spark.table("throttle").collect())) == sorted(map(tuple, batch.collect()))


def test_append_once(spark, tmp_path):
    from partwise.streaming import logs

    sink = logs.append_once(spark, str(tmp_path / "out"), "id", "id long")
    batch = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_word_similarity_takes_any_stretch(spark):
    from pyspark.sql import functions as F

    from partwise.functions import rank

    rows = [("word", "two words", 0.8), ("word", "", 0.0), ("abc", "abc", 1.0), ("alpha beta gamma delta", "x alpha beta gamma delta y", 1.0)]
    got = spark.createDataFrame(rows, "n string, t string, want double").select(rank.word_similarity(F.col("n"), F.col("t")).alias("s"), "want").collect()
    assert all(abs(r["s"] - r["want"]) < 1e-9 for r in got)


def test_keyed_digest_is_hmac(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    from partwise.plans import catalogue as registry  # noqa: F401  loads the modules of queries, in order
    from partwise.plans.extras import keyed_digest

    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("é",), ("",), (None,)], "v string").select(keyed_digest(F.col("v"), key).alias("h")).collect()
        assert [r["h"] for r in got] == [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in ("é", "")] + [None]


def test_perceptual_hash_against_the_definition(spark):
    import math

    import numpy as np

    from partwise.plans import catalogue as registry

    rows = registry.QUERIES["hash_phash"](spark, "/root/testdata/sf0.001").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(5).collect()}
    for r in rows:
        if r["vec_id"] in vectors:
            g = np.array(vectors[r["vec_id"]], dtype=float).reshape(8, 8)
            low = [sum(g[y, x] * math.cos(math.pi * (2 * y + 1) * v / 16) * math.cos(math.pi * (2 * x + 1) * u / 16) for y in range(8) for x in range(8)) for v in range(8) for u in range(8)]
            middle = sorted(low)[31:33]
            assert r["phash"] == f"{int(''.join('1' if x > sum(middle) / 2 else '0' for x in low), 2):016x}"
