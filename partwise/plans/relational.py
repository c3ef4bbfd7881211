"""Filters, projections, joins, set operations and top-k of the catalogue workload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.plans.registry import query, table

AS_OF = "TIMESTAMP_NTZ '1998-01-01 00:00:00'"


def conjunction(conditions: list[Column]) -> Column:
    """AND of the conditions that a caller gave; TRUE for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def prioritized(left: DataFrame, choices: list[tuple[DataFrame, Column]], value: str) -> DataFrame:
    """Left join with fallbacks: the first table with a match gives ``value``.

    Each choice has unique keys and its own column of that name.
    """
    out = left
    for i, (right, on) in enumerate(choices):
        out = out.join(right.withColumnRenamed(value, f"_{value}{i}"), on, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_{value}{i}") for i in range(len(choices))]))


# Filters ---------------------------------------------------------------------

@query("""SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND starts_with(p_brand, 'Brand#1')""")
def flt_conjunction(spark, sf_dir):
    asked = {"at_least": 10, "at_most": 20, "brand": "Brand#1", "kind": None}
    conditions = []
    if asked["at_least"] is not None:
        conditions.append(F.col("p_size") >= asked["at_least"])
    if asked["at_most"] is not None:
        conditions.append(F.col("p_size") <= asked["at_most"])
    if asked["brand"] is not None:
        conditions.append(F.startswith("p_brand", F.lit(asked["brand"])))
    if asked["kind"] is not None:
        conditions.append(F.col("p_type") == asked["kind"])
    return table(spark, sf_dir, "part").where(conjunction(conditions)).select("p_partkey", "p_brand", "p_size")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'brass')""")
def flt_or_match(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("red")) | F.contains(F.lower("p_type"), F.lit("brass"))).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, coalesce(l.l_linestatus, 'O') AS state FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) l ON o_orderkey = l_orderkey WHERE l.l_linestatus = 'O' OR l.l_linestatus IS NULL""")
def flt_null_aware(spark, sf_dir):
    """Rows whose outer-joined state is open or absent."""
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linestatus")
    state = F.coalesce("l_linestatus", F.lit("O"))
    return table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("state", state).where("state = 'O'").select("o_orderkey", "state")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def flt_in_list(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '1998-01-01') AS active FROM orders""")
def flt_active_upload(spark, sf_dir):
    """Processing, or pending and not yet expired at a fixed instant."""
    active = (F.col("o_orderstatus") == "O") | ((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") > F.expr(AS_OF)))
    return table(spark, sf_dir, "orders").select("o_orderkey", active.alias("active"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND ((o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1995-06-01') OR (o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-06-01'))""")
def flt_retention(spark, sf_dir):
    """Eligible for clean-up: not cleaned, and long rejected or long expired."""
    rejected = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") <= F.expr("TIMESTAMP_NTZ '1995-06-01 00:00:00'"))
    expired = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'"))
    return table(spark, sf_dir, "orders").where((F.col("o_orderpriority") != "1-URGENT") & (rejected | expired)).select("o_orderkey")


@query("""SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 AND n_regionkey <> 0""")
def flt_importable(spark, sf_dir):
    """Sources that are enabled, active and licensed (balance, and a region that isn't blocked)."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(nation, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("""SELECT conv_id, CAST(count(*) FILTER (WHERE role <> 'system') AS BIGINT) AS visible, coalesce(string_agg(CASE WHEN role <> 'system' THEN role END, ',' ORDER BY turn), '') AS roles FROM conversations GROUP BY conv_id""")
def flt_visibility(spark, sf_dir):
    """Entries that only teachers may see are taken out of the nested list."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    shown = F.filter("turns", lambda x: x["role"] != "system")
    return turns.select("conv_id", F.size(shown).cast("long").alias("visible"), F.array_join(F.transform(shown, lambda x: x["role"]), ",").alias("roles"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'price_low' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '5-LOW' THEN 'low_priority' ELSE 'ok' END AS reason FROM orders""")
def flt_first_failure(spark, sf_dir):
    """Ordered checks; the first that fails names the reason."""
    checks = [(F.col("o_totalprice") < 1000, "price_low"), (F.col("o_orderstatus") == "P", "pending"), (F.col("o_orderpriority") == "5-LOW", "low_priority")]
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in checks], F.lit("ok"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) > 18 THEN 'title_long' END, CASE WHEN p_size > 45 THEN 'size_range' END,
  CASE WHEN p_retailprice <= 900 THEN 'price_low' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-4][1-5]$') THEN 'brand_pattern' END) AS violations FROM part""")
def flt_validate_draft(spark, sf_dir):
    """All violations of a draft, in rule order."""
    rules = [(F.length("p_name") > 18, "title_long"), (F.col("p_size") > 45, "size_range"), (F.col("p_retailprice") <= 900, "price_low"), (~F.col("p_brand").rlike("^Brand#[1-4][1-5]$"), "brand_pattern")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in rules]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("violations"))


@query("""SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, count(*) > 12 OR sum(CAST(o_totalprice AS DECIMAL(18,2))) > 2000000 AS over_quota FROM orders GROUP BY o_custkey""")
def flt_quota(spark, sf_dir):
    """Count and size quotas per owner."""
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), total.cast("decimal(28,2)").alias("total"))
    return out.withColumn("over_quota", (F.col("n_orders") > 12) | (F.col("total") > 2_000_000))


# Projections -----------------------------------------------------------------

@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events""")
def prj_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'budget' WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'metal' WHEN ends_with(p_type, 'BRASS') THEN 'brass' ELSE 'other' END AS category FROM part""")
def prj_case_map(spark, sf_dir):
    category = F.when(F.startswith("p_type", F.lit("ECONOMY")), "budget").when(F.col("p_type").rlike("STEEL|TIN"), "metal").when(F.endswith("p_type", F.lit("BRASS")), "brass").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", category.alias("category"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":{"key":' || r_regionkey || ',"name":"' || r_name || '"}}' AS document FROM nation JOIN region ON n_regionkey = r_regionkey""")
def prj_nested_doc(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return joined.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("region"))).alias("document"))


@query("""SELECT n_nationkey, n_name AS name, r_regionkey AS region_key, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def prj_doc_to_rows(spark, sf_dir):
    """Nested documents parsed by schema into typed rows."""
    card = F.from_json("document", "name string, region struct<key:int,name:string>")
    return prj_nested_doc(spark, sf_dir).select("n_nationkey", card.alias("c")).select("n_nationkey", "c.name", F.col("c.region.key").alias("region_key"), F.col("c.region.name").alias("region_name"))


# Joins -----------------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 7""")
def join_search(spark, sf_dir):
    """Fact with two dimensions; the filter on the dimension reaches its scan."""
    part = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("""SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey""")
def join_card_tags(spark, sf_dir):
    """Many-to-many bridge."""
    bridge = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return bridge.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type").distinct()


@query("""SELECT p_partkey, p_brand, u.n_name AS unit FROM part LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) u ON p_size = u.n_nationkey""")
def join_card_specs(spark, sf_dir):
    """Values with an optional unit."""
    units = table(spark, sf_dir, "nation").where("n_nationkey < 10").select("n_nationkey", F.col("n_name").alias("unit"))
    return table(spark, sf_dir, "part").join(units, F.col("p_size") == F.col("n_nationkey"), "left").select("p_partkey", "p_brand", "unit")


@query("""SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def join_sources(spark, sf_dir):
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("""SELECT p_partkey, count(l_orderkey) AS n_specs, min(l_quantity) AS least FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def join_dedup_specs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_specs"), F.min("l_quantity").alias("least"))
    return table(spark, sf_dir, "part").select("p_partkey").join(lines, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "n_specs", "least")


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1997-01-01' AND c_acctbal > 0""")
def join_session(spark, sf_dir):
    """Valid sessions: not revoked, not expired, owner active."""
    valid = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & (F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"))).select("o_orderkey", "o_custkey")
    return valid.join(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""SELECT count(DISTINCT c_custkey) AS admins FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal > 0""")
def join_admins(spark, sf_dir):
    roles = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(roles, "c_custkey", "left_semi").agg(F.count("*").alias("admins"))


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' ORDER BY l_orderkey DESC, l_linenumber LIMIT 50""")
def join_jobs(spark, sf_dir):
    assets = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")
    jobs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return jobs.join(assets, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus").orderBy(F.desc("l_orderkey"), "l_linenumber").limit(50)


@query("""SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def join_review_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("""SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'none') AS state, CAST(coalesce(c.n, 0) AS BIGINT) AS n_actions, coalesce(c.last_role, 'none') AS last_role
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT conv_id, count(*) AS n, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id) c ON d.doc_id = c.conv_id""")
def join_metrics(spark, sf_dir):
    """Draft with optional state and its grouped action log."""
    log = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max_by("role", "turn").alias("last_role"))
    states = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("state"))
    out = table(spark, sf_dir, "documents").select("doc_id").join(states, "doc_id", "left").join(log, "doc_id", "left")
    return out.select("doc_id", F.coalesce("state", F.lit("none")).alias("state"), F.coalesce("n", F.lit(0)).alias("n_actions"), F.coalesce("last_role", F.lit("none")).alias("last_role"))


@query("""SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) m ON c.conv_id = m.conv_id AND c.turn = m.turn""")
def join_latest(spark, sf_dir):
    """Latest revision per key in one pass: no second scan and join."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("m")).select("conv_id", "m.turn", "m.role")


@query("""SELECT d.doc_id, u.h FROM documents d JOIN (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) = 1) u ON sha256(d.text) = u.h""")
def join_unique_pairs(spark, sf_dir):
    """Rows whose normalized key occurs once: grouped, not joined to its own groups."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return keyed.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("doc_id", "h")


@query("""
SELECT o.o_orderkey, coalesce(a.s_suppkey, b.s_suppkey) AS match FROM orders o
LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) a ON o.o_orderkey % 400 = a.s_suppkey
LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) b ON o.o_custkey % 30 = b.s_nationkey""")
def join_exact_dup(spark, sf_dir):
    """Match by the stronger key, else by the weaker one."""
    supplier = table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 400).alias("k1"), (F.col("o_custkey") % 30).alias("k2"))
    strong = supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("a_key"), F.col("s_suppkey").alias("match"))
    weak = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("match"))
    return prioritized(orders, [(strong, F.col("k1") == F.col("a_key")), (weak, F.col("k2") == F.col("s_nationkey"))], "match").select("o_orderkey", "match")


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2)""")
def join_orphans(spark, sf_dir):
    """Listed objects that neither of two tables refers to."""
    lines = table(spark, sf_dir, "lineitem")
    used = lines.where("l_linenumber = 1").select("l_orderkey").unionByName(lines.where("l_linenumber = 2").select("l_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("""SELECT count(*) AS missing, count(*) = 0 AS covered FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def join_subset(spark, sf_dir):
    """Is every requested id known? An anti join and a count."""
    asked = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    known = table(spark, sf_dir, "part").where("p_size < 40").select("p_partkey")
    return asked.join(known, "p_partkey", "left_anti").agg(F.count("*").alias("missing")).withColumn("covered", F.col("missing") == 0)


LINE = "unnest(string_split(text, chr(10)))"


@query(f"""SELECT DISTINCT d.doc_id, b.item_id FROM (SELECT doc_id, {LINE} AS line FROM documents) d JOIN (SELECT item_id, {LINE} AS line FROM benchmark) b ON sha256(d.line) = sha256(b.line) WHERE length(d.line) > 20""")
def join_index_exact(spark, sf_dir):
    """Exact look-up of query lines in an index of record lines, by digest."""
    lines = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 20").select(key, F.sha2("line", 256).alias("h"))
    return lines("documents", "doc_id").join(lines("benchmark", "item_id"), "h").select("doc_id", "item_id").distinct()


@query("""
SELECT p.p_partkey, coalesce(s.label, g.label) AS label FROM part p
LEFT JOIN (SELECT 'ECONOMY' AS prefix, 4 AS size, 'economy-four' AS label UNION ALL SELECT 'STANDARD', 7, 'standard-seven') s ON split_part(p_type, ' ', 1) = s.prefix AND p_size = s.size
LEFT JOIN (SELECT 'ECONOMY' AS prefix, 'economy' AS label UNION ALL SELECT 'STANDARD', 'standard' UNION ALL SELECT 'PROMO', 'promo') g ON split_part(p_type, ' ', 1) = g.prefix""")
def join_registry(spark, sf_dir):
    """Profile-specific definition first, generic one else (both tables are constants)."""
    special = F.broadcast(spark.createDataFrame([("ECONOMY", 4, "economy-four"), ("STANDARD", 7, "standard-seven")], "prefix1 string, size int, label string"))
    generic = F.broadcast(spark.createDataFrame([("ECONOMY", "economy"), ("STANDARD", "standard"), ("PROMO", "promo")], "prefix2 string, label string"))
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    return prioritized(table(spark, sf_dir, "part"), [(special, (first == F.col("prefix1")) & (F.col("p_size") == F.col("size"))), (generic, first == F.col("prefix2"))], "label").select("p_partkey", "label")


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS same_as FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.l_discount = b.l_discount AND a.l_tax = b.l_tax WHERE a.l_linenumber < b.l_linenumber""")
def join_snapshot_media(spark, sf_dir):
    """Equality on five columns between two versions."""
    keys = ["l_orderkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    lines = table(spark, sf_dir, "lineitem").select(*keys, "l_linenumber")
    return lines.join(lines.withColumnRenamed("l_linenumber", "same_as"), keys).where("l_linenumber < same_as").select("l_orderkey", "l_linenumber", "same_as")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS legacy, b.n AS pipeline FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k""")
def join_legacy_fields(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda flag, name: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias(name))
    return side("R", "legacy").join(side("A", "pipeline"), "k", "full")


# Top-k, pages and set operations -----------------------------------------------

@query("""SELECT p_partkey, p_retailprice FROM part WHERE p_size > 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")
def topk_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 5").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 50""")
def topk_preselect(spark, sf_dir):
    """The 50 best per source; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").withColumn("rn", rank).where("rn <= 50").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def topk_candidates(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("rn", rank.cast("long")).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def page_offset(spark, sf_dir):
    """One page with the total of the same predicate."""
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    page = jobs.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20).select("o_orderkey")
    return page.join(F.broadcast(jobs.agg(F.count("*").alias("total"))), how="inner")  # one row


@query("""SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, doc_id DESC) AS rank FROM labels) WHERE rank <= 100""")
def sort_custom_order(spark, sf_dir):
    """Severity first, then newest id: top 100 with their place."""
    severity = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    top = table(spark, sf_dir, "labels").select("doc_id", severity.alias("s")).orderBy("s", F.desc("doc_id")).limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy("s", F.desc("doc_id"))).cast("long").alias("rank"))


@query("""SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier""")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'""")
def set_intersect(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey").intersect(lines.where("l_returnflag = 'A'").select("l_partkey"))


@query("""SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def set_except(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey").subtract(lines.where("l_quantity > 45").select("l_partkey"))


@query("""SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01' EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'""")
def set_symdiff_files(spark, sf_dir):
    """Removed between two snapshots."""
    lines = table(spark, sf_dir, "lineitem")
    old = lines.where("l_shipdate < TIMESTAMP_NTZ '1995-03-01 00:00:00'").select("l_partkey").distinct()
    return old.join(lines.where("l_shipdate >= TIMESTAMP_NTZ '2001-06-01 00:00:00'").select("l_partkey"), "l_partkey", "left_anti")


@query("""SELECT p_partkey, list_aggregate(list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')), 'count') AS n_tokens, CAST(len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) AS BIGINT) AS n_shared FROM part""")
def set_token_ops(spark, sf_dir):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_union(a, b)).cast("long").alias("n_tokens"), F.size(F.array_intersect(a, b)).cast("long").alias("n_shared"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY conv_id""")
def dedup_ordered(spark, sf_dir):
    """First occurrences in order."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    ordered = F.sort_array(F.collect_list(F.struct("first", "role")))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))
