"""Review metrics on documents and their labels: a short rule predicts quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.operators import metrics
from partwise.plans.registry import query, table

Z = "1.959963984540054::DOUBLE"


def _rate_sql(h: str, n: str) -> dict[str, str]:
    p, d = f"({h} / nullif({n}, 0)::DOUBLE)", f"nullif({n}, 0)::DOUBLE"
    centre = f"(({p} + {Z} * {Z} / (2 * {d})) / (1 + {Z} * {Z} / {d}))"
    margin = f"({Z} * sqrt({p} * (1 - {p}) / {d} + {Z} * {Z} / (4 * {d} * {d})) / (1 + {Z} * {Z} / {d}))"
    e = lambda x: f"CAST(round_even({x} * 1000, 0) AS BIGINT)"
    null = lambda x: f"CASE WHEN {n} > 0 THEN {e(x)} END"
    return {"": null(p), "_lower": null(f"greatest(0.0, {centre} - {margin})"), "_upper": null(f"least(1.0, {centre} + {margin})")}


# Candidates: state and life cycle made from ids, so that every branch of the cascade occurs.
CANDIDATES = """c AS (SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 11 = 0 THEN 'pending' ELSE 'confirmed' END AS review_state,
  CASE WHEN d.doc_id % 13 = 0 THEN 'stale' WHEN d.doc_id % 17 = 0 THEN 'conflict' WHEN d.doc_id % 19 = 0 THEN 'suggested' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS lifecycle,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL WHEN d.doc_id % 29 = 0 THEN 'accepted' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS last_decision,
  CASE WHEN length(d.text) > 600 THEN 'auto_accepted' WHEN length(d.text) > 200 THEN 'review' ELSE 'rejected' END AS matcher_decision,
  CASE WHEN length(d.text) % 2 = 0 THEN 'exact' ELSE 'variant' END AS initial_relation, CASE WHEN length(d.text) % 3 = 0 THEN 'exact' ELSE 'variant' END AS final_relation
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
x AS (SELECT *, CASE WHEN review_state <> 'confirmed' THEN 'pending_or_missing_confirmation' WHEN lifecycle = 'stale' THEN 'stale' WHEN lifecycle = 'conflict' THEN 'conflict' WHEN lifecycle NOT IN ('accepted', 'rejected') THEN 'unresolved' WHEN last_decision IS NULL THEN 'unreviewed' WHEN last_decision <> lifecycle THEN 'lifecycle_mismatch' END AS excluded,
  CASE WHEN matcher_decision = 'rejected' THEN 'no_match' ELSE initial_relation END AS predicted, CASE WHEN lifecycle = 'accepted' THEN final_relation ELSE 'no_match' END AS actual FROM c),
s AS (SELECT * FROM x WHERE excluded IS NULL)"""


def candidates(spark, sf_dir) -> DataFrame:
    every = lambda n: F.col("doc_id") % n == 0
    good, size = F.col("quality") == 1, F.length("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    verdict = F.when(good, "accepted").otherwise("rejected")
    return rows.select(
        "doc_id", "lang",
        F.when(every(11), "pending").otherwise("confirmed").alias("review_state"),
        F.when(every(13), "stale").when(every(17), "conflict").when(every(19), "suggested").otherwise(verdict).alias("lifecycle"),
        F.when(every(23), F.lit(None)).when(every(29), "accepted").otherwise(verdict).alias("last_decision"),
        F.when(size > 600, "auto_accepted").when(size > 200, "review").otherwise("rejected").alias("matcher_decision"),
        F.when(size % 2 == 0, "exact").otherwise("variant").alias("initial_relation"),
        F.when(size % 3 == 0, "exact").otherwise("variant").alias("final_relation"),
    )


def samples(spark, sf_dir) -> DataFrame:
    return metrics.labelled(candidates(spark, sf_dir)).where(F.col("excluded").isNull())


def _report_sql(by: str, p: str, a: str) -> str:
    cells = {"true_positive": f"{p} AND {a}", "false_positive": f"{p} AND NOT {a}", "false_negative": f"NOT {p} AND {a}", "true_negative": f"NOT {p} AND NOT {a}"}
    inner = f"SELECT {by}, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in cells.items()) + f" FROM s GROUP BY {by}"
    rates = [f"{v} AS {name}{k}" for name, h, n in (("precision", "true_positive", "(true_positive + false_positive)"), ("recall", "true_positive", "(true_positive + false_negative)"), ("accuracy", "(true_positive + true_negative)", "n")) for k, v in _rate_sql(h, n).items()]
    return f"WITH {CANDIDATES}, r AS ({inner}) SELECT *, {', '.join(rates)} FROM r"


@query(_report_sql("lang", "(predicted <> 'no_match')", "(actual <> 'no_match')"))
def agg_rate_ci(spark, sf_dir):
    """Precision, recall and accuracy with 95 % Wilson intervals per language: the flagship."""
    return metrics.report(samples(spark, sf_dir), ["lang"])


@query(_report_sql("matcher_decision", "(predicted = 'exact')", "(actual = 'exact')"))
def agg_confusion_binary(spark, sf_dir):
    """One label against the rest."""
    return metrics.report(samples(spark, sf_dir), ["matcher_decision"], "exact")


@query(f"""WITH {CANDIDATES} SELECT r.label AS excluded, CAST(count(x.doc_id) AS BIGINT) AS n FROM (VALUES ('pending_or_missing_confirmation'), ('stale'), ('conflict'), ('unresolved'), ('unreviewed'), ('lifecycle_mismatch')) r(label) LEFT JOIN x ON x.excluded = r.label GROUP BY 1""")
def agg_exclusions(spark, sf_dir):
    """Counts of the exclusive reasons; reasons without a case stay with zero."""
    reasons = spark.createDataFrame([(r,) for r in ("pending_or_missing_confirmation", "stale", "conflict", "unresolved", "unreviewed", "lifecycle_mismatch")], "excluded string")
    counts = metrics.labelled(candidates(spark, sf_dir)).where(F.col("excluded").isNotNull()).groupBy("excluded").agg(F.count("*").alias("n"))
    return reasons.join(counts, "excluded", "left").select("excluded", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {CANDIDATES} SELECT r.d AS matcher_decision, CAST(count(s.doc_id) AS BIGINT) AS sample_size, CAST(count(*) FILTER (WHERE lifecycle = 'accepted') AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE lifecycle = 'rejected') AS BIGINT) AS rejected, CAST(count(*) FILTER (WHERE initial_relation <> final_relation) AS BIGINT) AS changed FROM (VALUES ('auto_accepted'), ('review'), ('rejected')) r(d) LEFT JOIN s ON s.matcher_decision = r.d GROUP BY 1""")
def agg_decision_outcomes(spark, sf_dir):
    """Outcome per matcher decision; decisions without samples stay with zero."""
    domain = spark.createDataFrame([("auto_accepted",), ("review",), ("rejected",)], "matcher_decision string")
    found = samples(spark, sf_dir).groupBy("matcher_decision").agg(F.count("*").alias("sample_size"), F.count_if(F.col("lifecycle") == "accepted").alias("accepted"), F.count_if(F.col("lifecycle") == "rejected").alias("rejected"), F.count_if(F.col("initial_relation") != F.col("final_relation")).alias("changed"))
    return domain.join(found, "matcher_decision", "left").fillna(0)


@query(f"""WITH {CANDIDATES} SELECT p.l AS predicted, a.l AS actual, CAST(count(s.doc_id) AS BIGINT) AS n FROM (VALUES ('exact'), ('variant'), ('related'), ('no_match')) p(l) CROSS JOIN (VALUES ('exact'), ('variant'), ('related'), ('no_match')) a(l) LEFT JOIN s ON s.predicted = p.l AND s.actual = a.l GROUP BY 1, 2""")
def agg_confusion_matrix(spark, sf_dir):
    """All pairs of labels with explicit zeros (a constant grid of labels)."""
    labels = ["exact", "variant", "related", "no_match"]
    grid = spark.createDataFrame([(p, a) for p in labels for a in labels], "predicted string, actual string")
    counts = samples(spark, sf_dir).groupBy("predicted", "actual").agg(F.count("*").alias("n"))
    return grid.join(counts, ["predicted", "actual"], "left").fillna(0)


@query(f"""WITH {CANDIDATES} SELECT lang, initial_relation, sha256(lang || chr(10) || initial_relation) AS rule_set, count(*) AS n, count(*) FILTER (WHERE predicted = actual) AS correct FROM s GROUP BY 1, 2""")
def agg_version_slices(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("lang", "initial_relation").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("actual")).alias("correct")).withColumn("rule_set", F.sha2(F.concat_ws("\n", "lang", "initial_relation"), 256))


@query(f"""WITH {CANDIDATES} SELECT lang, CAST(count(*) FILTER (WHERE lifecycle = 'accepted') * 1000 // nullif(count(*) FILTER (WHERE lifecycle IN ('accepted', 'rejected')), 0) AS BIGINT) AS precision FROM c GROUP BY lang""")
def agg_proxy_precision(spark, sf_dir):
    """accepted * 1000 div (accepted + rejected); null without decisions."""
    counts = candidates(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("lifecycle") == "accepted").alias("a"), F.count_if(F.col("lifecycle").isin("accepted", "rejected")).alias("n"))
    return counts.selectExpr("lang", "a * 1000 div nullif(n, 0) AS precision")


@query("""SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) AS BIGINT) AS common, CAST(count(*) FILTER (WHERE l_discount > 0) AS BIGINT) AS legacy, CAST(count(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) * 1000 // nullif(count(*) FILTER (WHERE l_discount > 0), 0) AS BIGINT) AS coverage FROM lineitem GROUP BY 1""")
def agg_coverage(spark, sf_dir):
    has = lambda c: F.col(c) > 0
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(has("l_discount") & has("l_tax")).alias("common"), F.count_if(has("l_discount")).alias("legacy"))
    return counts.selectExpr("*", "common * 1000 div nullif(legacy, 0) AS coverage")


FIELDS = ["lang", "source", "n_chars"]


@query("""WITH o AS (SELECT doc_id, unnest(['lang', 'source', 'n_chars']) AS field, unnest([lang, source, CAST(n_chars AS VARCHAR)]) AS value FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, unnest(['lang', 'source', 'n_chars']) AS field, unnest([CASE WHEN doc_id % 5 = 1 THEN upper(lang) ELSE lang END, source, CAST(length(text) AS VARCHAR)]) AS value FROM documents WHERE doc_id % 9 <> 0)
SELECT coalesce(o.field, n.field) AS field, CAST(count(*) FILTER (WHERE sha256(o.value) = sha256(n.value)) AS BIGINT) AS same, CAST(count(*) FILTER (WHERE sha256(o.value) <> sha256(n.value)) AS BIGINT) AS different, CAST(count(*) FILTER (WHERE n.doc_id IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE o.doc_id IS NULL) AS BIGINT) AS additional FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.field = n.field GROUP BY 1""")
def cmp_shadow(spark, sf_dir):
    """Field-level difference of two versions by value digest."""
    docs = table(spark, sf_dir, "documents")
    unpivot = lambda df, values, name: df.select("doc_id", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*values))).alias("field", name))
    old = unpivot(docs.where("doc_id % 10 <> 0"), [F.col("lang"), F.col("source"), F.col("n_chars").cast("string")], "o")
    new = unpivot(docs.where("doc_id % 9 <> 0"), [F.when(F.col("doc_id") % 5 == 1, F.upper("lang")).otherwise(F.col("lang")), F.col("source"), F.length("text").cast("string")], "n")
    old, new = old.withColumn("has_o", F.lit(True)), new.withColumn("has_n", F.lit(True))
    both = old.join(new, ["doc_id", "field"], "full")
    same = F.sha2("o", 256) == F.sha2("n", 256)
    return both.groupBy("field").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("different"), F.count_if(F.col("has_n").isNull()).alias("missing"), F.count_if(F.col("has_o").isNull()).alias("additional"))


@query("""SELECT source, count(*) AS entries, CAST(count(*) FILTER (WHERE n_chars > 50) AS BIGINT) AS complete, CAST(count(*) FILTER (WHERE n_chars <= 50) AS BIGINT) AS rejected, CAST(sum(n_chars) // count(*) AS BIGINT) AS mean_chars FROM documents GROUP BY source""")
def cmp_batch(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("entries"), F.count_if(F.col("n_chars") > 50).alias("complete"), F.count_if(F.col("n_chars") <= 50).alias("rejected"), F.sum("n_chars").alias("total"))
    return out.selectExpr("source", "entries", "complete", "rejected", "total div entries AS mean_chars")


@query("""SELECT lang, count(*) AS n, count(*) >= 100 AS enough, min(n_chars) > 0 AS all_filled FROM documents GROUP BY lang""")
def val_samples(spark, sf_dir):
    """Acceptance report: enough samples, none empty."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), (F.count("*") >= 100).alias("enough"), (F.min("n_chars") > 0).alias("all_filled"))
