"""Sinks and mutations: versioned tables, read back as written, and plain joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.operators import tables as t
from partwise.operators.versioned import VersionedTable
from partwise.plans.registry import query, table


def halves(spark, sf_dir):
    """An existing table and a batch that overlaps it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))


def versioned(rows: DataFrame, keys: list[str], buckets: int = 16) -> VersionedTable:
    """A new versioned table in the shared folder."""
    return VersionedTable.create(rows, f"{t.shared_folder(rows.sparkSession)}/partwise/table-{uuid.uuid4().hex}", keys, buckets)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'N' END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")
def sink_insert_ignore(spark, sf_dir):
    """Rows with a known key are ignored; the table is read back as written."""
    old, new = halves(spark, sf_dir)
    stored = versioned(old, ["o_orderkey"])
    return stored.read(stored.insert_ignore(new)).select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")
def sink_upsert(spark, sf_dir):
    """Rows with a known key replace it; the table is read back as written."""
    old, new = halves(spark, sf_dir)
    stored = versioned(old, ["o_orderkey"])
    return stored.read(stored.upsert(new)).select("o_orderkey", "o_orderstatus")


@query("""SELECT version, o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, unnest([0, 1]) AS version FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N', 1 FROM orders WHERE o_orderkey % 2 = 0)""")
def sink_append_log(spark, sf_dir):
    """A log keeps every entry: both versions as read back, the second with the batch added."""
    old, new = halves(spark, sf_dir)
    stored = versioned(old, ["o_orderkey"])
    stored.append(new)
    each = [stored.read(v).select(F.lit(v).alias("version"), "o_orderkey", "o_orderstatus") for v in (0, 1)]
    return each[0].unionByName(each[1])


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations WHERE conv_id % 2 = 0 OR turn = 0 GROUP BY conv_id""")
def sink_replace_children(spark, sf_dir):
    """The turns of a conversation are its children: those in the batch replace all that were there."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    stored = versioned(turns.where("turn = 0"), ["conv_id"])
    rows = stored.read(stored.replace_children(turns.where("conv_id % 2 = 0")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("""SELECT DISTINCT p_type AS name, 'custom-' || substr(sha256(p_type), 1, 16) AS key FROM part""")
def sink_get_or_create(spark, sf_dir):
    """Natural key to a stable generated key."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().withColumn("key", F.concat(F.lit("custom-"), F.substring(F.sha2("name", 256), 1, 16)))


@query("""SELECT c_custkey, coalesce(o.last, c_name) AS name FROM customer LEFT JOIN (SELECT o_custkey, 'last-' || max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey""")
def sink_update_from(spark, sf_dir):
    """UPDATE ... FROM: join and coalesce(new, old)."""
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("last-"), F.max("o_orderkey")).alias("c_name"))
    return t.update_from(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), new, ["c_custkey"]).select("c_custkey", F.col("c_name").alias("name"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def sink_delete_using(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS planned FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""")
def sink_dry_run(spark, sf_dir):
    """What an insert would add, without writing."""
    old, new = halves(spark, sf_dir)
    return t.new_rows(old, new, ["o_orderkey"]).agg(F.count("*").alias("planned"))


@query("""SELECT lang, '{"lang":"' || lang || '","n":' || count(*) || '}' AS report FROM documents GROUP BY lang""")
def sink_json_report(spark, sf_dir):
    """Byte-stable report lines, keys sorted."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.to_json(F.struct("lang", "n")).alias("report"))
