"""State machines on logs: publishing gates, claims, reviews, sessions, throttling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.operators import lifecycle
from partwise.plans.registry import query, table


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_draft' WHEN n.k IS NULL THEN 'no_sources' WHEN n.k < 2 THEN 'media_missing' WHEN n.r > 0 THEN 'duplicates_open' ELSE 'publishable' END AS gate FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) n ON o_orderkey = l_orderkey""")
def st_publish(spark, sf_dir):
    """The first gate that a draft fails."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gate = F.when(F.col("o_orderstatus") == "P", "not_draft").when(F.col("k").isNull(), "no_sources").when(F.col("k") < 2, "media_missing").when(F.col("r") > 0, "duplicates_open").otherwise("publishable")
    return rows.select("o_orderkey", gate.alias("gate"))


@query("""SELECT o_orderkey, o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01') AS claimable, CAST(least(60000, 5000 * pow(2, greatest(0, o_orderkey % 6 - 1))) AS BIGINT) AS wait_ms FROM orders""")
def st_import_claim(spark, sf_dir):
    """Queued, or running with an expired lease at a fixed instant; with the wait before a retry."""
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "O") | stale).alias("claimable"), lifecycle.backoff_ms(F.col("o_orderkey") % 6).alias("wait_ms"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber >= 6 THEN 'failed' WHEN l_linestatus = 'F' THEN 'done' WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'claim' ELSE 'leased' END AS action FROM lineitem""")
def st_media_claim(spark, sf_dir):
    """Exhausted attempts fail; finished jobs rest; expired leases are claimed."""
    action = F.when(F.col("l_linenumber") >= 6, "failed").when(F.col("l_linestatus") == "F", "done").when(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"), "claim").otherwise("leased")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", action.alias("action"))


def review_start(user: int) -> lifecycle.Review:
    """Every draft: three enrichments, two of one external identity; the third is stale for every fourth draft."""
    own = {"e0": ["suggested", "r0", "x"], "e1": ["suggested", "r1", "x"], "e2": ["stale" if user is not None and user % 4 == 0 else "suggested", "r2", "y"]}
    return lifecycle.Review(own, ["i0", "i1"], ["s0", "s1"], {"p1", "p2", "p3", "p4"}, identity="i0")


def review_actions(events: DataFrame) -> DataFrame:
    """The event log read as actions on drafts: seven kinds by turns; every eleventh names the revision that it expects."""
    e, n = F.col("event_id"), F.floor(F.col("event_id") / 7)
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    action = F.element_at(F.array(*[F.lit(x) for x in lifecycle.ACTIONS]), (e % 7 + 1).cast("int"))
    target = F.when(e % 7 < 3, named("e", n % 4)).when(e % 7 == 3, named("i", n % 3)).when(e % 7 == 4, named("s", n % 3)).when(e % 7 == 5, named("c", n % 4))
    value = F.when(e % 7 == 2, named("r", F.floor(e / 28) % 3)).when(e % 7 == 4, named("p", F.floor(e / 21) % 5))
    return events.select("user_id", "event_id", action.alias("action"), target.alias("target"), value.alias("value"), F.when(e % 11 == 0, e % 40).alias("expected"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id % 7 AS a, event_id // 7 AS n, (event_id // 28) % 3 AS rel, (event_id // 21) % 5 AS path, CASE WHEN event_id % 11 = 0 THEN event_id % 40 END AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(1 AS BIGINT) AS rev, false AS conf, [0, 0, CASE WHEN user_id % 4 = 0 THEN 3 ELSE 0 END] AS s, CAST([0, 1, 2] AS BIGINT[]) AS r, CAST(0 AS BIGINT) AS ident, CAST([NULL, NULL] AS BIGINT[]) AS m, [false, false, false, false] AS iss, CAST(0 AS BIGINT) AS refused, '' AS code FROM e
 UNION ALL SELECT user_id, rn, CASE WHEN c = 'ok' THEN rev + 1 ELSE rev END, conf OR (c = 'ok' AND a = 6), CASE WHEN c = 'ok' AND a < 3 THEN list_transform(s, lambda x, i: CASE WHEN i = n % 4 + 1 THEN [1, 2, 0][a + 1] ELSE x END) ELSE s END,
  CASE WHEN c = 'ok' AND a = 2 THEN list_transform(r, lambda x, i: CASE WHEN i = n % 4 + 1 THEN rel ELSE x END) ELSE r END, CASE WHEN c = 'ok' AND a = 3 THEN n % 3 ELSE ident END, CASE WHEN c = 'ok' AND a = 4 THEN list_transform(m, lambda x, i: CASE WHEN i = n % 3 + 1 THEN path ELSE x END) ELSE m END,
  CASE WHEN c = 'ok' AND a = 5 THEN list_transform(iss, lambda x, i: x OR i = n % 4 + 1) ELSE iss END, CASE WHEN c = 'ok' THEN refused ELSE refused + 1 END, c
 FROM (SELECT f.user_id, e.rn, f.rev, f.conf, f.s, f.r, f.ident, f.m, f.iss, f.refused, e.a, e.n, e.rel, e.path,
  CASE WHEN expected <> rev THEN 'import_review_revision_conflict' WHEN conf THEN 'import_review_already_confirmed' WHEN a < 3 AND n % 4 = 3 THEN 'enrichment_not_found' WHEN a < 3 AND s[n % 4 + 1] = 3 THEN 'stale_enrichment_review_forbidden'
   WHEN a = 2 AND r[n % 4 + 1] = rel THEN 'enrichment_relation_unchanged' WHEN a = 2 AND n % 4 < 2 AND r[2 - n % 4] = rel THEN 'enrichment_relation_conflict' WHEN a = 3 AND n % 3 = 2 THEN 'identity_candidate_not_found' WHEN a = 3 AND n % 3 = ident THEN 'identity_candidate_already_selected'
   WHEN a = 4 AND path = 0 THEN 'specification_taxonomy_path_unknown' WHEN a = 4 AND n % 3 = 2 THEN 'unmapped_specification_not_found' WHEN a = 6 AND (list_contains(s, 0) OR list_contains(s, 3)) THEN 'draft_enrichments_unresolved' WHEN a = 6 AND (m[1] IS NULL OR m[2] IS NULL) THEN 'draft_specifications_unmapped' ELSE 'ok' END AS c
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, rev AS revision, CASE WHEN conf THEN 'confirmed' ELSE 'pending' END AS status, array_to_string(list_transform(s, lambda x, i: 'e' || (i - 1) || '=' || ['suggested', 'accepted', 'rejected', 'stale'][x + 1]), ',') AS enrichments, array_to_string(list_transform(r, lambda x, i: 'e' || (i - 1) || '=r' || x), ',') AS relations,
 'i' || ident AS identity, array_to_string(list_filter(list_transform(m, lambda x, i: 's' || (i - 1) || '=p' || x), lambda x: x IS NOT NULL), ',') AS mapped, array_to_string(list_filter(list_transform(iss, lambda x, i: CASE WHEN x THEN 'c' || (i - 1) END), lambda x: x IS NOT NULL), ',') AS issues, refused AS n_refused, code AS last_code
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS l FROM f) WHERE l = 1""")
def st_review(spark, sf_dir):
    """Fold of an action log: seven actions with their checks of revision, state and target; confirmed only if all is resolved and mapped."""
    return lifecycle.reviewed(review_actions(table(spark, sf_dir, "events")), "user_id", ["event_id"], review_start)


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'suggested' WHEN d.source <> 'src1' AND d.doc_id % 7 = 0 THEN 'stale' WHEN l.toxic = 1 THEN 'conflict' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def st_enrichment(spark, sf_dir):
    """Stale where the provider's revision has changed, else the reviewed status."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "suggested").when((F.col("source") != "src1") & (F.col("doc_id") % 7 == 0), "stale").when(F.col("toxic") == 1, "conflict").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return rows.select("doc_id", status.alias("status"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error'),
f AS (SELECT user_id, rn, t AS since, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS until, CAST(0 AS BIGINT) AS blocks FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, CASE WHEN f.since + 900 <= e.t THEN e.t ELSE f.since END, CASE WHEN f.since + 900 <= e.t THEN 1 ELSE f.n + 1 END,
  CASE WHEN CASE WHEN f.since + 900 <= e.t THEN 1 ELSE f.n + 1 END >= 5 THEN e.t + 900 WHEN f.since + 900 <= e.t THEN NULL ELSE f.until END,
  f.blocks + CASE WHEN CASE WHEN f.since + 900 <= e.t THEN 1 ELSE f.n + 1 END >= 5 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, since, n, until, blocks FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS l FROM f) WHERE l = 1""")
def st_throttle(spark, sf_dir):
    """Fixed-window throttling of failures per user."""
    failures = table(spark, sf_dir, "events").where("event_type = 'error'")
    return lifecycle.throttled(failures, "user_id", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("""SELECT o_orderkey, o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1996-01-01' AND c_acctbal > 0 AND n_nationkey IS NOT NULL AS valid FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def st_session(spark, sf_dir):
    """Not revoked, not expired, user active, with a role."""
    users = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("role")), "c_nationkey", "left")
    rows = table(spark, sf_dir, "orders").join(users.select("c_custkey", "c_acctbal", "role"), F.col("o_custkey") == F.col("c_custkey"), "left")
    valid = (F.col("o_orderstatus") != "F") & (F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")) & (F.col("c_acctbal") > 0) & F.col("role").isNotNull()
    return rows.select("o_orderkey", valid.alias("valid"))


@query("""SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def stream_latest_state(spark, sf_dir):
    """Latest state per key of an append-only log (the batch form of the stream in partwise.streaming)."""
    return lifecycle.latest(table(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_id", "event_type"])
