"""Window functions: ordinals, latest rows, margins, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partwise.plans.registry import query, table


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey) - 1 AS ordinal FROM lineitem""")
def win_row_number(spark, sf_dir):
    """Zero-based ordinal per owner and kind."""
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_shipdate", "l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (n - 1).cast("long").alias("ordinal"))


@query("""SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey""")
def win_distinct_on(spark, sf_dir):
    """First per key: a min over structs needs no sort."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")).select("o_custkey", F.col("f.o_orderkey").alias("o_orderkey"))


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant') WHERE rn = 1""")
def win_latest_snapshot(spark, sf_dir):
    """Latest published revision of every key in one pass."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("n", n).where("n = 1").select("conv_id", "turn", "text")


@query("""SELECT user_id, max_by(event_type, event_id) AS last_decision FROM events WHERE event_type <> 'view' GROUP BY user_id""")
def win_last_decision(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_decision"))


@query("""SELECT o_custkey, best, coalesce(best - second, 0) AS margin FROM (SELECT o_custkey, max(p) FILTER (WHERE rn = 1) AS best, max(p) FILTER (WHERE rn = 2) AS second FROM (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS rn FROM orders) GROUP BY 1)""")
def win_top2_margin(spark, sf_dir):
    """Best score minus the runner-up, 0 if alone."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("p"), "o_orderkey")
    priced = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    ranked = priced.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("p").over(w)).where("rn = 1")
    return ranked.select("o_custkey", F.col("p").alias("best"), F.coalesce(F.col("p") - F.col("second"), F.lit(0)).cast("decimal(19,2)").alias("margin"))


@query("""SELECT conv_id, min(turn) AS first_turn, min_by(role, turn) AS signal FROM conversations WHERE contains(lower(text), 'the') GROUP BY conv_id""")
def win_first_match(spark, sf_dir):
    """The first signal that holds a rule's token."""
    hits = table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("the")))
    return hits.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("signal"))


@query("""SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM conversations""")
def win_section_id(spark, sf_dir):
    """A heading opens a section; lines belong to the last heading."""
    section = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", section.alias("section"))


LINES = "SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("i"), "line")


@query(f"""SELECT doc_id, i, sum(CASE WHEN ends_with(line, '.') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM ({LINES})""")
def win_fence_parity(spark, sf_dir):
    """Inside or outside of a fence: parity of the running count of fence lines."""
    n = F.sum(F.when(F.endswith("line", F.lit(".")), 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines(spark, sf_dir).select("doc_id", "i", (n % 2 == 1).alias("inside"))


@query(f"""
WITH l AS (SELECT doc_id, i, length(line) AS n, CASE WHEN length(line) < 80 THEN 1 ELSE 0 END AS brk FROM ({LINES})),
     g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM l)
SELECT doc_id, CAST(grp AS BIGINT) AS paragraph, min(i) AS first_line, max(i) AS last_line, CAST(sum(n) AS BIGINT) AS n_chars FROM g WHERE brk = 0 GROUP BY doc_id, grp""")
def win_paragraphs(spark, sf_dir):
    """Consecutive long lines form a paragraph (gaps and islands)."""
    broken = F.when(F.length("line") < 80, 1).otherwise(0)
    rows = lines(spark, sf_dir).withColumn("brk", broken)
    rows = rows.withColumn("grp", F.sum("brk").over(Window.partitionBy("doc_id").orderBy("i"))).where("brk = 0")
    return rows.groupBy("doc_id", F.col("grp").alias("paragraph")).agg(F.min("i").alias("first_line"), F.max("i").alias("last_line"), F.sum(F.length("line").cast("long")).alias("n_chars"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_linenumber, l_partkey) - 1 AS ordinal FROM lineitem""")
def win_renumber_merge(spark, sf_dir):
    """The survivor's rows first, then the loser's, numbered anew."""
    w = Window.partitionBy("l_orderkey").orderBy(F.when(F.col("l_returnflag") == "N", 0).otherwise(1), "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query("""SELECT l_orderkey, arg_min(l_linenumber, (CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 2 END) * 1000 + l_linenumber) AS chosen FROM lineitem GROUP BY l_orderkey""")
def win_primary_pick(spark, sf_dir):
    """Primary, else the first ready one, else the first."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_linestatus") == "F", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(rank, F.col("l_linenumber"))).alias("chosen"))


@query("""SELECT count(*) FILTER (WHERE prev IS NOT NULL AND prev > event_id) AS out_of_order, count(*) AS n FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def st_stage_order(spark, sf_dir):
    """Strict order of stages: no row may precede the one before it."""
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", prev.alias("prev")).agg(F.count_if(F.col("prev") > F.col("event_id")).alias("out_of_order"), F.count("*").alias("n"))
