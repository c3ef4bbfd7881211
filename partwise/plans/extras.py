"""The remaining operators: signals, leases, legacy units, keyed and perceptual hashes, publishing."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from partwise.functions.text import spaced_key
from partwise.operators import specs, tables
from partwise.operators.similarity import similar_pairs, trigram_table
from partwise.plans.dedup import BLOCKS, PRESELECT, SIGNALS, model_of, signals
from partwise.plans.normalize import raw_specs
from partwise.plans.registry import query, table


@query(f"""WITH {SIGNALS} SELECT p_partkey, array_to_string(list_sort(tokens), ' ') AS tokens, array_to_string(specs, '|') AS specs, model, sha256(words) AS texts, media, ph AS phash FROM sg""")
def dup_signals(spark, sf_dir):
    """One row of signals per component."""
    rows = signals(table(spark, sf_dir, "part"), "s")
    one = lambda c: F.get(f"s_{c}", F.lit(0)).alias(c)
    return rows.select(F.col("s_p_partkey").alias("p_partkey"), F.array_join(F.array_sort("s_tokens"), " ").alias("tokens"), F.array_join("s_specs", "|").alias("specs"), F.col("s_model").alias("model"), one("texts"), one("media"), one("phash"))


@query(BLOCKS + """, m AS (SELECT DISTINCT a, b FROM al WHERE a <> b) SELECT a AS p_partkey, count(*) AS n_similar FROM m GROUP BY a""")
def join_trigram_self(spark, sf_dir):
    """How many other components have a similar title or a similar model.

    Distinct titles and distinct models are paired; a component counts those by title and those by model, less those by
    both, which are found from the pairs of titles whose bearers have similar models.
    """
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", model_of().alias("model"))

    def alike(text: str) -> DataFrame:
        grams = trigram_table(rows.select(text).where(F.col(text) != "").distinct(), text, text)
        return similar_pairs(grams, grams, PRESELECT).select("a", "b").unionByName(grams.select(F.col("key").alias("a"), F.col("key").alias("b")))

    titles, models = alike("p_name"), alike("model")
    kinds = rows.groupBy("p_name", "model").agg(F.count("*").alias("n"))  # components of one title and model count together
    bearing = lambda text: kinds.where(F.col(text) != "").groupBy(F.col(text).alias("b")).agg(F.sum("n").alias("n"))
    by_title = titles.join(bearing("p_name"), "b").groupBy(F.col("a").alias("p_name")).agg(F.sum("n").alias("by_title"))
    by_model = models.join(bearing("model"), "b").groupBy(F.col("a").alias("model")).agg(F.sum("n").alias("by_model"))
    ours, theirs = kinds.select(F.col("p_name").alias("ta"), F.col("model").alias("a")), kinds.select(F.col("p_name").alias("tb"), F.col("model").alias("b"), "n")
    both = ours.join(models, "a").join(theirs, "b").join(titles.select(F.col("a").alias("ta"), F.col("b").alias("tb")), ["ta", "tb"]).groupBy(F.col("ta").alias("p_name"), F.col("a").alias("model")).agg(F.sum("n").alias("by_both"))
    n = F.coalesce("by_title", F.lit(0)) + F.coalesce("by_model", F.lit(0)) - F.coalesce("by_both", F.lit(0)) - 1
    found = rows.join(by_title, "p_name", "left").join(by_model, "model", "left").join(both, ["p_name", "model"], "left")
    return found.select("p_partkey", n.alias("n_similar")).where("n_similar > 0")


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AS lease_expired FROM orders WHERE o_orderstatus = 'P'""")
def date_lease(spark, sf_dir):
    """now - lease, at a fixed now."""
    limit = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00' - INTERVAL 30 DAYS")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_orderdate") < limit).alias("lease_expired"))


# Keys of the older specification list, their labels, and the names under which they come.
LEGACY_SPECS = [
    ("supply-voltage", "Supply voltage", ["supply", "supply voltage", "input voltage", "working voltage", "rated voltage", "voltage"]),
    ("operating-voltage", "Operating voltage", ["operating voltage", "operation voltage", "operational voltage"]),
    ("operating-current", "Operating current", ["current", "current consumption", "operating current", "operation current", "working current"]),
    ("power-consumption", "Power consumption", ["power consumption", "rated power", "max power", "maximum power"]),
    ("operating-temperature", "Operating temperature", ["operating temperature", "operating temperature range", "operation temperature", "working temperature", "temperature range"]),
    ("measurement-range", "Measurement range", ["detection range", "measuring range", "measurement range", "operating range", "range", "sensing range"]),
    ("accuracy", "Accuracy", ["accuracy", "measurement accuracy"]),
    ("resolution", "Resolution", ["resolution"]),
    ("frequency", "Frequency", ["frequency", "operating frequency", "sampling frequency"]),
    ("dimensions", "Dimensions", ["dimensions", "dimension", "product size", "size"]),
    ("weight", "Weight", ["net weight", "weight"]),
    ("interface", "Interface", ["bus", "communication interface", "interface", "protocol"]),
    ("connector", "Connector", ["connector", "connector type"]),
    ("electrical-life", "Electrical life", ["electrical life", "mechanical life"]),
    ("actuation-force", "Actuation force", ["actuation force", "operation force", "operating force"]),
]
LONGEST_VALUE = 2_000
#: Every name as it may be written, and some that no key has; a part's label is the one at its key modulo their number.
WRITTEN = [f"{n.upper()} :" if i % 3 == 0 else f"  {n.replace(' ', ' - ')}" if i % 3 == 1 else n.capitalize() for i, n in enumerate(n for _, _, names in LEGACY_SPECS for n in names)] + ["Colour", "Warranty (years)", "", "Supply/voltage", "actuation-force"]


def legacy_specification(label: Column, value: Column) -> Column:
    """(key, label, value) of a label and value by the older list; null for an unknown label or an empty value."""
    names = F.create_map(*[F.lit(x) for key, _, own in LEGACY_SPECS for n in dict.fromkeys([*own, key.replace("-", " ")]) for x in (n, key)])
    labels = F.create_map(*[F.lit(x) for key, shown, _ in LEGACY_SPECS for x in (key, shown)])
    key, text = names[spaced_key(label)], F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(key.isNotNull() & (text != ""), F.struct(key.alias("key"), labels[key].alias("label"), F.substring(text, 1, LONGEST_VALUE).alias("value")))


_names = ", ".join(f"('{n}', '{key}', '{shown}')" for key, shown, own in LEGACY_SPECS for n in dict.fromkeys([*own, key.replace("-", " ")]))


@query(f"""
WITH n(name, key, label) AS (VALUES {_names}), p AS (SELECT p_partkey, {WRITTEN}[1 + p_partkey % {len(WRITTEN)}] AS raw, CASE WHEN p_partkey % 13 = 0 THEN '   ' ELSE '  ' || p_size || '   V ' END AS value FROM part)
SELECT p_partkey, n.key, n.label, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value FROM p JOIN n ON n.name = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) WHERE trim(value) <> ''""")
def map_spec_v1(spark, sf_dir):
    """Labels by the older list: fifteen keys with all their names, however written; unknown ones and empty values are left out."""
    raw = F.element_at(F.array(*[F.lit(x) for x in WRITTEN]), (F.col("p_partkey") % len(WRITTEN) + 1).cast("int"))
    value = F.when(F.col("p_partkey") % 13 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("p_size"), F.lit("   V ")))
    found = table(spark, sf_dir, "part").select("p_partkey", legacy_specification(raw, value).alias("x")).where("x IS NOT NULL")
    return found.select("p_partkey", "x.key", "x.label", "x.value")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size || '-' || (p_size + 5) || ' V' WHEN 1 THEN p_size || ' mA' WHEN 2 THEN 'IIC' ELSE 'red' END AS value FROM part""")
def qty_unit_v1(spark, sf_dir):
    """Legacy unit rewriting by patterns in order."""
    c = F.col("value")
    for pattern, new in ((r"(?i)\s*volts?\b", " V"), (r"(?i)\s*milliamps?\b", " mA"), (r"([0-9])\s+to\s+([0-9])", "$1-$2")):
        c = F.regexp_replace(c, pattern, new)
    return raw_specs(spark, sf_dir).select("p_partkey", c.alias("value"))


@query("""SELECT r_regionkey, r_name FROM region""")
def sink_artifact_publish(spark, sf_dir):
    """An artifact is written once, to a path that must not exist, and read back."""
    path = f"{tables.shared_folder(spark)}/artifact-{uuid.uuid4().hex}"
    tables.publish_once(table(spark, sf_dir, "region"), path)
    return spark.read.parquet(path).select("r_regionkey", "r_name")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 0) AS valid, count(*) = count(*) FILTER (WHERE value >= 0) AS passed FROM events GROUP BY 1""")
def val_jobs(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 0).alias("valid"))
    return out.withColumn("passed", F.col("n") == F.col("valid"))


def keyed_digest(value: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in lower-case hex: two rounds of SHA-256 over constant pads."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


_pads = ["".join(f"{x ^ pad:02x}" for x in b"example-key".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""SELECT c_custkey, sha256(from_hex('{_pads[1]}') || from_hex(sha256(from_hex('{_pads[0]}') || encode(c_name)))) AS pseudonym FROM customer""")
def hash_hmac(spark, sf_dir):
    """Pseudonyms (the key is an example; a deployment passes its own)."""
    return table(spark, sf_dir, "customer").select("c_custkey", keyed_digest(F.col("c_name"), b"example-key").alias("pseudonym"))


def perceptual_bits(grid: np.ndarray) -> int:
    """64 bits: two-dimensional cosine transform of an 8 x 8 grid against its median."""
    k = np.arange(8)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 16)
    low = basis @ grid @ basis.T
    return int("".join("1" if x > np.median(low) else "0" for x in low.ravel()), 2)


@F.pandas_udf(StringType())
def perceptual_hash(values: pd.Series) -> pd.Series:
    return values.map(lambda v: f"{perceptual_bits(np.asarray(v, dtype=float).reshape(8, 8)):016x}" if len(v) == 64 else None, na_action="ignore")


@query()
def hash_phash(spark, sf_dir):
    """Perceptual hash of a vector read as an 8 x 8 grid."""
    return table(spark, sf_dir, "embeddings").select("vec_id", perceptual_hash("embedding").alias("phash"))
