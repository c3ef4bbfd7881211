"""Scans and sources (table, key and child scans; file maps, listings, page metadata)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.plans.registry import query, table
from partwise.sources.pages import SUPPORTED_SUFFIXES, page_metadata, url_policy_columns


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def scan_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42""")
def scan_pk(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_mktsegment")


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_children,
       coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS children
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def scan_child_ordered(spark, sf_dir):
    """Children in position order on their parent: one grouped pass instead of a look-up per parent."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return joined.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_children"), F.coalesce(text, F.lit("")).alias("children"))


#: A snapshot of more files than this is refused; digests are combined in so many groups.
MOST_FILES, MOST_BYTES, DIGEST_GROUPS = 10_000, 2 * 1024 * 1024, 64


def snapshot(pages: DataFrame) -> DataFrame:
    """A bounded file map of (page_id, url, html): path, size and count limits, content digest of every file, and the revision that pins all of them.

    ``files_sha256`` is a digest of the digests of groups of files, whatever their number. It is the ``revision`` of a map that
    is taken; a map of more than ``MOST_FILES`` is refused and has none, but is counted and digested as whole as any other.
    """
    n, path = F.octet_length("html").cast("long"), F.ltrim(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("/"))
    files = pages.agg(F.count("*").alias("files"))
    own = pages.select("page_id", F.sha2("html", 256).alias("h"))
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: F.concat_ws(":", x[key], x[value])), ","), 256)
    groups = own.groupBy(F.coalesce(F.pmod("page_id", F.lit(DIGEST_GROUPS)), F.lit(-1)).alias("g")).agg(joined("page_id", "h").alias("d"))
    whole = files.join(F.broadcast(groups.agg(joined("g", "d").alias("files_sha256"))), how="inner")  # one row each
    whole = whole.withColumn("revision", F.when(F.col("files") <= MOST_FILES, F.col("files_sha256")))
    verdict = F.when(n > MOST_BYTES, "file_too_large").when(path.rlike(r"(^|/)\.\.?(/|$)|^$"), "path_unsafe").when(F.col("files") > MOST_FILES, "too_many_files").otherwise("ok")
    return pages.join(F.broadcast(whole), how="inner").select("page_id", path.alias("path"), n.alias("n_bytes"), F.sha2("html", 256).alias("content_sha256"), verdict.alias("verdict"), "revision", "files_sha256")  # whole: one row


@query("""
WITH g AS (SELECT page_id % 64 AS g, sha256(string_agg(page_id || ':' || sha256(html), ',' ORDER BY page_id)) AS d FROM pages GROUP BY 1)
SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/') AS path, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS content_sha256,
  CASE WHEN octet_length(encode(html)) > 2097152 THEN 'file_too_large' WHEN regexp_matches(ltrim(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/'), '(^|/)[.][.]?(/|$)|^$') THEN 'path_unsafe' WHEN (SELECT count(*) FROM pages) > 10000 THEN 'too_many_files' ELSE 'ok' END AS verdict,
  CASE WHEN (SELECT count(*) FROM pages) <= 10000 THEN (SELECT sha256(string_agg(g || ':' || d, ',' ORDER BY g)) FROM g) END AS revision,
  (SELECT sha256(string_agg(g || ':' || d, ',' ORDER BY g)) FROM g) AS files_sha256 FROM pages""")
def src_snapshot(spark, sf_dir):
    """The pages as a bounded file map."""
    return snapshot(table(spark, sf_dir, "pages"))


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages
WHERE contains(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/en/') ORDER BY path, page_id LIMIT 100""")
def src_repo_discover(spark, sf_dir):
    """Supported files whose path holds a substring, first 100 by path (the cap is the feature)."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(F.contains("path", F.lit("/en/"))).orderBy("path", "page_id").limit(100)


@query("""
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[a-z]+://') THEN 'malformed'
  WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN regexp_matches(url, '^[a-z]+://[^/]*@') THEN 'credentials'
  WHEN regexp_matches(url, '^[a-z]+://[^/:]+:[0-9]+') THEN 'port' WHEN contains(url, '#') THEN 'fragment' ELSE 'ok' END AS verdict,
  lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
  coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/+$', ''), ''), '/') AS path FROM pages""")
def url_policy(spark, sf_dir):
    verdict, host, path = url_policy_columns(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"), host.alias("host"), path.alias("path"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading,
  CASE WHEN NOT regexp_matches(html, '<link[^>]+rel="canonical"') THEN 'canonical_missing'
       WHEN NOT regexp_matches(html, '<meta[^>]+name="description"') THEN 'description_missing' ELSE 'ok' END AS drift FROM pages""")
def src_html_meta(spark, sf_dir):
    """Page metadata with a drift code where the page's shape has changed."""
    return page_metadata(table(spark, sf_dir, "pages")).select("page_id", "title", "heading", "drift")


@query("""
WITH p AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN ends_with(host, '.com') THEN 'com' WHEN ends_with(host, '.org') THEN 'org' WHEN ends_with(host, '.net') THEN 'net' ELSE 'none' END AS parser,
  CASE WHEN NOT (ends_with(host, '.com') OR ends_with(host, '.org') OR ends_with(host, '.net')) THEN 'host_not_allowed'
       WHEN regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) = '' THEN 'heading_missing'
       WHEN regexp_extract(html, '<p>([^<]*)', 1) = '' THEN 'body_missing' ELSE 'ok' END AS outcome FROM p""")
def src_site_adapters(spark, sf_dir):
    """One parser per site, chosen by host; typed drift errors instead of exceptions."""
    from partwise.sources.pages import site_outcome

    return site_outcome(table(spark, sf_dir, "pages"))


@query("""SELECT item_id, sha256(text) AS sha, CAST(length(text) AS BIGINT) + CASE WHEN item_id % 7 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN item_id % 7 = 0 THEN 'digest_mismatch' WHEN item_id % 11 = 0 THEN 'missing_in_manifest' ELSE 'ok' END AS verdict FROM benchmark""")
def src_index_artifact(spark, sf_dir):
    """A JSON index artifact against its manifest: records by schema, digests recomputed (every seventh record was altered on its way, every eleventh isn't listed)."""
    items = table(spark, sf_dir, "benchmark")
    altered = F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    lines = items.select(F.to_json(F.struct("item_id", altered.alias("text"), F.sha2("text", 256).alias("sha"))).alias("line"))
    manifest = items.where("item_id % 7 = 0 OR item_id % 11 <> 0").select(F.col("item_id").alias("listed"), F.sha2("text", 256).alias("expected"))
    parsed = lines.select(F.from_json("line", "item_id bigint, text string, sha string").alias("r")).select("r.*").join(manifest, F.col("item_id") == F.col("listed"), "left")
    verdict = F.when(F.col("expected").isNull(), "missing_in_manifest").when(F.sha2("text", 256) != F.col("expected"), "digest_mismatch").otherwise("ok")
    return parsed.select("item_id", "sha", F.length("text").cast("long").alias("size"), verdict.alias("verdict"))


@query("""SELECT page_id, 'pages/' || page_id || '.html' AS object_key, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE html IS NOT NULL ORDER BY object_key LIMIT 1000""")
def src_object_listing(spark, sf_dir):
    """A bounded object listing by key (the bound is the feature)."""
    key = F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html"))
    return table(spark, sf_dir, "pages").where(F.col("html").isNotNull()).select("page_id", key.alias("object_key"), F.octet_length("html").cast("long").alias("size")).orderBy("object_key").limit(1000)


@query()
def src_local_dir(spark, sf_dir):
    """A directory as files with digests of their content, which is read in pieces (``sources/files.py``), without reading links."""
    from partwise.sources.files import digested

    files = digested(spark, sf_dir, ".parquet")
    return files.select(F.regexp_extract("path", r"((?:[^/]+\.parquet/)?[^/]+)$", 1).alias("name"), "length", "sha", F.col("path").rlike("|".join(SUPPORTED_SUFFIXES)).alias("supported"))


@query("""
WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b([0-9]{1,3}(?:\\.[0-9]{1,3}){3})\\b', 1)) AS address FROM documents),
o AS (SELECT *, list_transform(string_split(address, '.'), lambda x: CAST(x AS INTEGER)) AS p, regexp_matches(address, '(^|[.])0[0-9]') AS padded FROM a),
n AS (SELECT *, p[1] * 16777216::BIGINT + p[2] * 65536 + p[3] * 256 + p[4] AS n FROM o),
nets(base, bits) AS (VALUES ('0.0.0.0', 8), ('10.0.0.0', 8), ('172.16.0.0', 12), ('192.0.0.0', 24), ('192.0.2.0', 24), ('192.168.0.0', 16), ('198.18.0.0', 15), ('198.51.100.0', 24), ('203.0.113.0', 24)),
m AS (SELECT list_sum(list_transform(string_split(base, '.'), lambda x, i: CAST(x AS BIGINT) << (8 * (4 - i)))) >> (32 - bits) AS net, 32 - bits AS rest FROM nets)
SELECT doc_id, address, CASE WHEN padded OR len(list_filter(p, lambda x: x > 255)) > 0 THEN 'malformed' WHEN p[1] = 127 THEN 'loopback' WHEN p[1] = 169 AND p[2] = 254 THEN 'link_local' WHEN p[1] BETWEEN 224 AND 239 THEN 'multicast' WHEN n = 0 THEN 'unspecified'
  WHEN p[1] >= 240 THEN 'reserved' WHEN EXISTS (SELECT 1 FROM m WHERE n >> rest = net) AND address NOT IN ('192.0.0.9', '192.0.0.10') THEN 'private' WHEN p[1] = 100 AND p[2] BETWEEN 64 AND 127 THEN 'not_global' ELSE 'ok' END AS verdict FROM n""")
def ip_policy(spark, sf_dir):
    """Addresses in documents, with the reason why a non-global one is rejected."""
    from partwise.sources.addresses import address_verdict

    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"), F.lit(1)))).alias("address"))
    return found.select("doc_id", "address", address_verdict(F.col("address")).alias("verdict"))


def libraries(spark, sf_dir):
    """One S-expression library per 20 benchmark items."""
    quoted = F.concat(F.lit('(symbol "S'), F.col("item_id"), F.lit('" (property "Description" "'), F.regexp_replace("text", r'["\\\n]', " "), F.lit('") (pin input line (number "1")))'))
    items = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 20).alias("lib"), quoted.alias("s"))
    return items.groupBy(F.col("lib").cast("string").alias("path")).agg(F.concat(F.lit("(symbol_lib "), F.array_join(F.sort_array(F.collect_list("s")), " "), F.lit(")")).cast("binary").alias("content"))


@query("""SELECT CAST(item_id // 20 AS VARCHAR) AS path, 'S' || item_id AS symbol, replace(replace(replace(text, chr(10), ' '), '"', ' '), chr(92), ' ') AS description, 1 AS n_pins, CAST(NULL AS VARCHAR) AS error FROM benchmark""")
def src_sexpr(spark, sf_dir):
    """Symbol records read from S-expression libraries."""
    from partwise.sources.sexpr import symbols

    return symbols(libraries(spark, sf_dir))
