"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_report, text_quality

    return mixed_report(read(spark, sf_dir, "documents"), text_quality(F.col("text")))


def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import through_archives

    return through_archives(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import through_files

    return through_files(read(spark, sf_dir, "documents"))


def op6_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_benchmark

    found = find_benchmark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_found_n_words").alias("n_words"),
        F.col("_found_n_hit").alias("n_hit"),
        F.size("_found_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found_items", ","), 256).alias("items_sha256"),
        (F.col("_found_n_hit") > 0).alias("contaminated"),
    )


def op7_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold, identified

    found = identified(read(spark, sf_dir, "documents"), ["doc_id", "text"])
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op5_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored

    return scored(read(spark, sf_dir, "documents"))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    found = personal_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_matches

    return license_matches(read(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clustered

    return clustered(read(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judged, rule_table

    return judged(read(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op13_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked

    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_pivot_top_k, op3_arc_to_warc, op4_huffman_tokens, op5_context_tree_score, op6_fm_decontaminate, op7_setsketch_near_duplicates, op8_pii_bootstrap, op9_license_scan, op10_language_id, op11_centroid_clusters, op12_url_filter, op13_tput_search)
}

# The same rows by plain SQL where it can express the contract (ASCII case only; words as the contracts say).
_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_folded = f"translate(coalesce(text, ''), '{_upper}', '{_lower}')"
_blank_words = f"regexp_extract_all({_folded}, '[^\\x20\\x09-\\x0D]+')"


def _clusters_sql(rounds: int = 10) -> str:
    """Lloyd's rounds one after another; all products are exact in doubles for components under 2^20."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, e, list_dot_product(e, e) AS ee, row_number() OVER () AS r FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
             "c0 AS MATERIALIZED (SELECT c, e, list_dot_product(e, e) AS ee FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v) WHERE c < 8)"]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.e, min(struct_pack(d := v.ee - 2 * list_dot_product(v.e, c.e) + c.ee, c := c.c)) AS best FROM v, c{i} c GROUP BY r, vec_id, v.e)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, p, floor(sum(x) / count(*)) AS x FROM (SELECT best.c AS c, unnest(e) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY c, p)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, e, list_dot_product(e, e) AS ee FROM (SELECT o.c, coalesce(n.e, o.e) AS e FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY p) AS e FROM s{i} GROUP BY c) n ON o.c = n.c))")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.c"""
    )


ORACLE: dict[str, str] = {
    "op1_mix_sources": f"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('17' || chr(31) || coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(text, chr(0))) AS tie,
  CASE WHEN length(text) > 0 THEN greatest(0.1::DOUBLE, length(translate(text, '0123456789*#$%&|<>{{}}[]=_~^@+\\/', '')) / CAST(length(text) AS DOUBLE)) ELSE 1.0::DOUBLE END AS w FROM documents),
k AS (SELECT *, -ln((('0x' || substr(tie, 1, 12))::BIGINT + 1) / CAST(281474976710656 AS DOUBLE)) / w AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, 2 * n / w AS full_at, row_number() OVER (ORDER BY 2 * n / w, source NULLS LAST) AS rn FROM s),
v AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT source, n, CASE WHEN full_at <= level THEN 2 * n ELSE least(2 * n, first_value(CASE WHEN full_at > level THEN level END IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w) END AS target FROM v),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t),
a AS (SELECT k.doc_id, k.size, e.source, e.n, e.target, e.epochs, e.target - e.epochs * e.n AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT source, arg_min(upto, (abs(upto - rest), upto)) AS best FROM (SELECT source, upto, rest FROM a UNION ALL SELECT source, 0, max(rest) FROM a GROUP BY source) GROUP BY source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND upto <= best THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM a JOIN c ON a.source IS NOT DISTINCT FROM c.source""",
    "op2_pivot_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5""",
    "op3_arc_to_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages), f AS (SELECT *, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY digest) AS again, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f""",
    "op6_fm_decontaminate": f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_folded}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, regexp_extract_all({_folded}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
o AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, o.i, o.n FROM o JOIN g ON o.n = g.n AND o.gram = g.gram),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN t ON w.doc_id = t.doc_id""",
    "op7_setsketch_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_blank_words} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.least, w.doc_id) AS kept FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a""",
    "op11_centroid_clusters": _clusters_sql(),
    "op12_url_filter": f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_upper}', '{_lower}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT p.host, p.path, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL)
SELECT page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path""",
    "op13_tput_search": f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_folded}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(ts)) AS BIGINT) AS l_all FROM t WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS term FROM t) GROUP BY ALL),
d AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
i AS (SELECT term, w, r, doc_id, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all)) AS impact FROM p JOIN d USING (term), s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_folded}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY ALL),
f AS (SELECT item_id, r, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, CAST(rn AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rn FROM f WHERE score > 0) WHERE rn <= 20""",
}
