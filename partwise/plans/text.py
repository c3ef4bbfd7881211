"""Scalar functions: text keys, tokens, numbers, hashes and quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions import text as fn
from partwise.operators.hamming import nearest_hashes
from partwise.plans.registry import also, query, table

FOLD = "replace(lower(trim(text)), 'ß', 'ss')"


@query(f"""SELECT doc_id, {FOLD} AS key FROM documents""")
def str_norm_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.search_key(F.col("text")).alias("key"))


@query(f"""SELECT doc_id, nullif(regexp_replace({FOLD}, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS key FROM documents""")
def str_norm_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.identity_key(F.col("text")).alias("key"))


@query(f"""SELECT doc_id, coalesce(array_to_string(regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{N}}]+'), ' '), '') AS key FROM documents""")
def str_norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.words_key(F.col("text")).alias("key"))


@query("""SELECT p_partkey, regexp_replace(lower(p_type || '-' || p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part""")
def str_compact(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.compact_key(F.concat_ws("-", "p_type", "p_brand")).alias("key"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_type || '/' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key FROM part""")
def str_spaced(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.spaced_key(F.concat_ws("/", "p_type", "p_brand")).alias("key"))


@query("""SELECT c_custkey, replace(lower(trim(c_name)), 'ß', 'ss') AS key FROM customer""")
def str_exact_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.search_key(F.col("c_name")).alias("key"))


@query("""SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80), ''), 'unknown') AS code FROM pages""")
def str_code_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.code_suffix(F.col("url")).alias("code"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[*_`]+', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS plain FROM pages""")
def str_clean_inline(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.clean_inline(F.col("html")).alias("plain"))


@query("""SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS plain FROM documents""")
def str_clean_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f]+", " ")).alias("plain"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS slug FROM part""")
def str_slug(spark, sf_dir):
    slug = F.btrim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", slug, F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 8)).alias("slug"))


@query("""SELECT doc_id FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ')""")
def str_padded_phrase(spark, sf_dir):
    """A phrase as whole words."""
    padded = F.concat(F.lit(" "), fn.spaced_key(F.col("text")), F.lit(" "))
    return table(spark, sf_dir, "documents").where(F.contains(padded, F.lit(" of the "))).select("doc_id")


@query("""SELECT p_partkey, array_to_string(list_filter(list_distinct_ordered, lambda t: length(t) >= 2 AND t NOT IN ('a','an','and','for','grove','module','of','the','with')), ' ') AS tokens FROM (SELECT p_partkey, list_filter(s, lambda t, i: list_position(s, t) = i) AS list_distinct_ordered FROM (SELECT p_partkey, string_split(trim(regexp_replace(lower(p_name || ' of the ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ') AS s FROM part))""")
def tok_index(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.index_tokens(F.concat_ws(" of the ", "p_name", "p_type")), " ").alias("tokens"))


@query("""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_name), '[a-z0-9]+(?:[-_./][a-z0-9]+)*'), lambda t: regexp_replace(t, '[^a-z0-9]+', '', 'g')), ' ') AS tokens FROM customer""")
def tok_identifier(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(fn.identifier_tokens(F.col("c_name")), " ").alias("tokens"))


@query("""SELECT page_id, array_to_string(list_filter(s, lambda t, i: list_position(s, t) = i), ' ') AS tokens FROM (SELECT page_id, list_filter(regexp_extract_all(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '[a-z0-9]+'), lambda t: length(t) >= 4 AND regexp_matches(t, '[0-9]') AND t <> 'ds002') AS s FROM pages)""")
def tok_datasheet(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(fn.datasheet_tokens(F.col("url")), " ").alias("tokens"))


@query("""SELECT p_partkey, array_to_string(list_filter(s, lambda t, i: list_position(s, t) = i), ' ') AS tokens FROM (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_type || ' package'), '[a-z]+'), lambda t: length(t) >= 2 AND t NOT IN ('filter','footprint','package')) AS s FROM part)""")
def tok_package(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.package_tokens(F.concat("p_type", F.lit(" package"))), " ").alias("tokens"))


@query("""SELECT conv_id, turn, len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[,;|]'), lambda t: trim(t)), lambda t: t <> ''))) AS n FROM conversations""")
def tok_split(spark, sf_dir):
    """Split at comma, semicolon and bar; distinct, not empty."""
    parts = F.filter(F.transform(F.split("text", "[,;|]"), lambda t: F.trim(t)), lambda t: t != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_distinct(parts)).cast("long").alias("n"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/+$', '') AS key FROM pages""")
def url_key(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)), "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(host, path).alias("key"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(t, '\\b(i2c|iic|twi)\\b') THEN 'i2c' END, CASE WHEN regexp_matches(t, '\\bspi\\b') THEN 'spi' END, CASE WHEN regexp_matches(t, '\\b(uart|serial)\\b') THEN 'uart' END, CASE WHEN regexp_matches(t, '\\busb\\b') THEN 'usb' END, CASE WHEN regexp_matches(t, '\\banalog\\b') THEN 'analog' END) AS interfaces
FROM (SELECT p_partkey, lower(CASE p_size % 4 WHEN 0 THEN 'IIC and SPI bus' WHEN 1 THEN 'Serial (USB)' WHEN 2 THEN 'analog out' ELSE p_name END) AS t FROM part)""")
def set_interfaces(spark, sf_dir):
    size = F.col("p_size") % 4
    said = F.when(size == 0, "IIC and SPI bus").when(size == 1, "Serial (USB)").when(size == 2, "analog out").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.interfaces(said), ",").alias("interfaces"))


@query("""SELECT doc_id, sha256(text) AS text_sha, sha256(source || chr(0) || lang) AS spec_sha FROM documents""")
def hash_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"), F.sha2(F.concat("source", F.lit("\0"), "lang"), 256).alias("spec_sha"))


SIGNS = "CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i > {0} AND i <= {0} + 32 THEN CAST(1 AS BIGINT) << (i - {0} - 1) ELSE 0 END)) AS BIGINT)"


def sign_hash(vector: str, first: int) -> Column:
    """The signs of 32 components from ``first`` on, as a number."""
    bits = F.transform(F.slice(vector, first + 1, 32), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


def nearest_signs(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, similarity) over 64 sign bits: the k nearest of all rows for every id divisible by 50; one of the k + 1 nearest of its hash may be itself."""
    hashes = vectors.select("vec_id", sign_hash("embedding", 0).alias("lo"), sign_hash("embedding", 32).alias("hi"))
    asked = hashes.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "a")
    near = nearest_hashes(asked, hashes, ["lo", "hi"], "vec_id", k + 1).withColumnRenamed("other", "b")
    own = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    found = asked.join(near, ["lo", "hi"]).where("a <> b").withColumn("rn", own).where(F.col("rn") <= k)
    return found.select("a", "b", (1 - F.col("apart") / F.lit(64.0)).alias("similarity"))


@query(f"""WITH h AS (SELECT vec_id, {SIGNS.format(0)} AS lo, {SIGNS.format(32)} AS hi FROM embeddings),
p AS (SELECT q.vec_id AS a, r.vec_id AS b, bit_count(xor(q.lo, r.lo)) + bit_count(xor(q.hi, r.hi)) AS apart FROM h q, h r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT a, b, 1 - apart / 64.0::DOUBLE AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY apart, b) AS rn FROM p) WHERE rn <= 10""")
def num_hamming_top(spark, sf_dir):
    """1 - differing bits / bits, over all 64 sign bits: ids divisible by 50 against all rows, the 10 nearest."""
    return nearest_signs(table(spark, sf_dir, "embeddings"))


also("num_hamming", of="num_hamming_top")  # its name while it took 62 bits and every tenth vector


@query("""SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)) AS share FROM customer""")
def num_bounded(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.bounded(F.col("c_acctbal") / 5000).alias("share"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(ceil(CAST(l_discount AS DECIMAL(6,4)) * 1000) AS BIGINT) AS per_mille FROM lineitem""")
def num_ceil_bp(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.ceil(F.col("l_discount").cast("decimal(6,4)") * 1000).cast("long").alias("per_mille"))


@query("""SELECT p_partkey, CASE WHEN n = '-0' OR n = '' THEN '0' ELSE n END AS number FROM (SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS n FROM part)""")
def num_canonical(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.canonical_number(F.concat(F.lit("+"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).alias("number"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'tolerance' ELSE 'scalar' END AS kind, CAST(p_size AS VARCHAR) AS low,
  CASE p_size % 3 WHEN 0 THEN CAST(p_size + 5 AS VARCHAR) WHEN 1 THEN '2' END AS high, CASE p_size % 3 WHEN 0 THEN 'V' WHEN 1 THEN 'mA' ELSE 'Ω' END AS unit FROM part""")
def qty_parse(spark, sf_dir):
    size = F.col("p_size").cast("string")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit(" to "), (F.col("p_size") + 5).cast("string"), F.lit(".0 Volts"))).when(F.col("p_size") % 3 == 1, F.concat(size, F.lit(" +/- 2.00mA"))).otherwise(F.concat(size, F.lit(" Ohms")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.quantity(said).alias("q")).select("p_partkey", "q.*")


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(p_size + 1 AS VARCHAR) AS b, CASE WHEN p_size % 2 = 0 THEN '3' END AS c, 'mm' AS unit FROM part""")
def qty_dimensions(spark, sf_dir):
    """``a x b [x c] unit``."""
    size = F.col("p_size")
    said = F.concat(size.cast("string"), F.lit(" x "), (size + 1).cast("string"), F.when(size % 2 == 0, F.lit(" × 3 mm")).otherwise(F.lit("mm")))
    pattern = r"^\s*([0-9.]+)\s*[x×]\s*([0-9.]+)(?:\s*[x×]\s*([0-9.]+))?\s*(mm|cm|in)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(said, pattern, i), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("unit"))


@query("""SELECT o_orderkey, CAST(least(60000, 5000 * pow(2, greatest(0, o_orderkey % 8 - 1))) AS BIGINT) AS backoff_ms FROM orders""")
def date_backoff(spark, sf_dir):
    wait = F.least(F.lit(60000.0), 5000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("o_orderkey") % 8 - 1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", wait.cast("long").alias("backoff_ms"))


@query("""SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS json FROM nation""")
def json_canonical(spark, sf_dir):
    """Fields in alphabetical order, no spaces."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("json"))


@query("""SELECT p_partkey, upper(replace(p_brand, '#', '-')) AS part_number FROM part WHERE regexp_matches(upper(replace(p_brand, '#', '-')), '^[A-Z0-9-]+$')""")
def map_part_number(spark, sf_dir):
    """Dashes folded, ASCII upper case, under a pattern."""
    number = F.upper(F.translate("p_brand", "#‐‑–—", "-----"))
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("part_number")).where(F.col("part_number").rlike("^[A-Z0-9-]+$"))


@query("""SELECT p_partkey, coalesce(m.name, p_brand) AS manufacturer FROM part LEFT JOIN (SELECT * FROM (VALUES ('brand#11', 'Eleven Ltd'), ('brand#12', 'Twelve Inc'), ('brand#23', 'Twenty-Three')) t(alias, name)) m ON lower(p_brand) = m.alias""")
def map_manufacturer(spark, sf_dir):
    """Alias dictionary (a constant)."""
    known = F.create_map(*[F.lit(x) for x in ("brand#11", "Eleven Ltd", "brand#12", "Twelve Inc", "brand#23", "Twenty-Three")])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(known[F.lower("p_brand")], F.col("p_brand")).alias("manufacturer"))
