"""Aggregations of the catalogue workload."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partwise.plans.registry import also, query, table

MONEY = "decimal(18,2)"


@query("""SELECT count(*) AS n_all, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pending, count(*) FILTER (WHERE o_totalprice > 200000) AS n_high FROM orders""")
def agg_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n_all"), F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"), F.count_if(F.col("o_totalprice") > 200000).alias("n_high"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ready, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F'), 0) AS DECIMAL(28,2)) AS used FROM orders GROUP BY o_custkey""")
def agg_count_filter_sum(spark, sf_dir):
    used = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast(MONEY)))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_ready"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.coalesce(used, F.lit(0)).cast("decimal(28,2)").alias("used"))


@query("""SELECT c_custkey, coalesce(max(o_orderkey) + 1, 0) AS next_ordinal FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""")
def agg_max_plus_one(spark, sf_dir):
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.col("last") + 1, F.lit(0)).alias("next_ordinal"))


@query("""SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def agg_max_by_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


@query("""SELECT lower(p_name || ' ' || p_type) || p_size AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1""")
def agg_having_unique(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.concat(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.col("p_size")).alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1").select("key", "p_partkey")


@query("""SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""")
def agg_string(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " ").alias("names"))


@query("""SELECT l_orderkey, l_partkey, count(DISTINCT l_quantity) AS n_values, count(DISTINCT l_suppkey) AS n_sections FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) >= 2 AND count(DISTINCT l_suppkey) >= 2""")
def agg_conflicts(spark, sf_dir):
    """Paths with two values or more from two sections or more."""
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.countDistinct("l_quantity").alias("n_values"), F.countDistinct("l_suppkey").alias("n_sections"))
    return out.where("n_values >= 2 AND n_sections >= 2")


@query("""SELECT conv_id, role, count(*) AS n, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS evidence FROM conversations GROUP BY conv_id, role""")
def agg_merge_evidence(spark, sf_dir):
    """Equal facts merge; their evidence keeps its order."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("turn")).cast("array<string>"), ",").alias("evidence"))


@query("""
WITH q AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS tok FROM part WHERE p_partkey % 50 = 0),
     r AS (SELECT DISTINCT p_partkey AS rec, unnest(string_split(lower(p_name), ' ')) AS tok FROM part),
     s AS (SELECT q.p_partkey, rec, count(*) AS shared FROM q JOIN r USING (tok) WHERE rec <> q.p_partkey GROUP BY 1, 2)
SELECT p_partkey, rec, shared FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, rec) AS rn FROM s) WHERE rn <= 5""")
def agg_token_overlap(spark, sf_dir):
    """Most shared tokens, top 5 per query (the query set is every fiftieth part)."""
    return most_shared(table(spark, sf_dir, "part"), 50)


def most_shared(parts, step: int, k: int = 5):
    """(p_partkey, rec, shared): the k parts that share most tokens of their names with every ``step``-th part.

    Only distinct names are held against each other. Ties go to the smaller key, so a name needs its k + 1 smallest
    keys: one of them may be the asking part itself.
    """
    nth = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    tokens = lambda names, key: names.select(F.col("p_name").alias(key), F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("tok"))
    asking = parts.where(F.col("p_partkey") % step == 0).select("p_partkey", "p_name")
    pairs = tokens(asking.select("p_name").distinct(), "ours").join(tokens(parts.select("p_name").distinct(), "theirs"), "tok").groupBy("ours", "theirs").agg(F.count("*").alias("shared"))
    bearers = parts.select(F.col("p_name").alias("theirs"), F.col("p_partkey").alias("rec")).withColumn("nth", nth("theirs", "rec")).where(F.col("nth") <= k + 1).drop("nth")
    near = pairs.join(bearers, "theirs").withColumn("nth", nth("ours", F.desc("shared"), "rec")).where(F.col("nth") <= k + 1).select(F.col("ours").alias("p_name"), "rec", "shared")
    found = asking.join(near, "p_name").where("rec <> p_partkey").withColumn("nth", nth("p_partkey", F.desc("shared"), "rec"))
    return found.where(F.col("nth") <= k).select("p_partkey", "rec", "shared")


also("agg_token_overlap_all", of="agg_token_overlap")  # its name while the plain one asked for fewer parts


@query("""SELECT event_type AS code, count(*) AS n, count(DISTINCT user_id) AS n_sources, min(event_id) AS first_seen FROM events GROUP BY event_type""")
def agg_group_warnings(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_sources"), F.min("event_id").alias("first_seen"))


@query("""SELECT p_partkey, CAST((p_size * 20 * 600 + least(1000, length(p_name) * 50) * 400) // 1000 AS BIGINT) AS overall FROM part""")
def agg_weighted_score(spark, sf_dir):
    """Weights of 1000 in all; integer division of the weighted sum."""
    total = F.col("p_size") * 20 * 600 + F.least(F.lit(1000), F.length("p_name") * 50) * 400
    return table(spark, sf_dir, "part").select("p_partkey", total.alias("t")).selectExpr("p_partkey", "t div 1000 AS overall")


@query("""SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS best_accepted, max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS best_review FROM lineitem GROUP BY l_orderkey""")
def agg_best(spark, sf_dir):
    best = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best("A").alias("best_accepted"), best("N").alias("best_review"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_batch_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(28,2)").alias("total"), F.count("*").alias("n"))


@query("""SELECT CAST(count(*) FILTER (WHERE kind = 'o' AND st = 'F') AS BIGINT) AS eligible, CAST(count(*) FILTER (WHERE kind = 'o' AND st = 'P') AS BIGINT) AS cleaned, CAST(count(*) FILTER (WHERE kind = 'x') AS BIGINT) AS orphans FROM (SELECT 'o' AS kind, o_orderstatus AS st FROM orders UNION ALL SELECT 'x', '' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""")
def agg_retention(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    orphans = orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(F.lit("x").alias("kind"), F.lit("").alias("st"))
    both = orders.select(F.lit("o").alias("kind"), F.col("o_orderstatus").alias("st")).unionByName(orphans)
    is_ = lambda k, s: (F.col("kind") == k) & (F.col("st") == s)
    return both.agg(F.count_if(is_("o", "F")).alias("eligible"), F.count_if(is_("o", "P")).alias("cleaned"), F.count_if(F.col("kind") == "x").alias("orphans"))


@query("""SELECT n_regionkey, sha256(string_agg(n_nationkey || ':' || n_name, '|' ORDER BY n_nationkey)) AS fingerprint FROM nation GROUP BY n_regionkey""")
def agg_fingerprint(spark, sf_dir):
    """Digest of canonical, ordered rows."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat_ws(":", x["n_nationkey"], x["n_name"]))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(rows, "|"), 256).alias("fingerprint"))
