"""Published-catalogue search: weighted documents, matching, ranking, trigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.functions import rank
from partwise.functions.text import trigrams
from partwise.operators import postings, tables
from partwise.operators.similarity import similar_pairs, trigram_table
from partwise.plans.registry import query, table

NEEDLE = ["blue", "small"]
# Trigrams in DuckDB: per word of [a-z0-9]+, two blanks before and one after.
GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def search_documents(spark, sf_dir):
    """Title = A, manufacturer and model = B, kind = C; newest id first on ties."""
    parts = [(F.col("p_name"), "A"), (F.col("p_brand"), "B"), (F.col("p_type"), "C")]
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", rank.weighted_tokens(parts).alias("tokens"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("all_text"))


def token_index(spark, sf_dir):
    """The stored positional index of all search documents, made once."""
    build = lambda: postings.token_postings(search_documents(spark, sf_dir), "p_partkey", "tokens")
    return tables.once(spark, sf_dir, "search-tokens", build, lambda df, name: tables.stored_by(df, name, "bucket", ["term"]))


def gram_index(spark, sf_dir):
    """The stored index of their trigrams, made once."""
    build = lambda: postings.gram_postings(search_documents(spark, sf_dir), "p_partkey", trigrams(F.col("all_text")))
    return tables.once(spark, sf_dir, "search-grams", build, lambda df, name: tables.stored_by(df, name, "bucket", ["term"]))


def grams_of(spark, needle: str) -> list[str]:
    """The distinct trigrams of a query."""
    return spark.range(1).select(trigrams(F.lit(needle)).alias("g")).first()["g"]


TOKENS = "(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: t || '=1.0') || list_transform(regexp_extract_all(lower(p_brand), '[a-z0-9]+'), lambda t: t || '=0.4') || list_transform(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda t: t || '=0.2'))"


@query(f"""SELECT p_partkey, array_to_string({TOKENS}, ' ') AS document FROM part""")
def fts_document(spark, sf_dir):
    shown = F.array_join(F.transform("tokens", lambda x: F.concat(x["t"], F.lit("="), x["w"].cast("string"))), " ")
    return search_documents(spark, sf_dir).select("p_partkey", shown.alias("document"))


@query("""SELECT p_partkey FROM part WHERE list_contains(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+'), 'blue') AND list_contains(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+'), 'small')""")
def fts_match(spark, sf_dir):
    """Every query token must occur; only the postings of these tokens are read."""
    return postings.with_all(token_index(spark, sf_dir), NEEDLE).select(F.col("key").alias("p_partkey"))


COVER = f"""
WITH t AS (SELECT p_partkey, unnest({TOKENS}) AS x, generate_subscripts({TOKENS}, 1) - 1 AS pos FROM part),
h AS (SELECT p_partkey, pos, split_part(x, '=', 1) AS tok, CAST(split_part(x, '=', 2) AS DOUBLE) AS w FROM t WHERE split_part(x, '=', 1) IN ('blue', 'small')),
l AS (SELECT *, max(pos) FILTER (WHERE tok = 'blue') OVER o AS p0, max(pos) FILTER (WHERE tok = 'small') OVER o AS p1 FROM h WINDOW o AS (PARTITION BY p_partkey ORDER BY pos)),
c AS (SELECT p_partkey, least(p0, p1) AS b, min(pos) AS e FROM l WHERE p0 IS NOT NULL AND p1 IS NOT NULL GROUP BY 1, 2),
r AS (SELECT c.p_partkey, round(sum(2 / (1 / x.w + 1 / y.w) / (1 + (c.e - c.b - 1))), 9) AS rank FROM c JOIN h x ON x.p_partkey = c.p_partkey AND x.pos = c.b JOIN h y ON y.p_partkey = c.p_partkey AND y.pos = c.e GROUP BY 1)"""


@query(COVER + """ SELECT p_partkey, rank FROM r""")
def fts_rank(spark, sf_dir):
    """Cover-density rank from the postings' places. No golden ranks exist; the two engines are held against each other."""
    hits = postings.with_all(token_index(spark, sf_dir), NEEDLE)
    return hits.select(F.col("key").alias("p_partkey"), F.round(rank.cover_rank(F.col("tokens"), NEEDLE), 9).alias("rank"))


@query(f"""
WITH d AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, {GRAMS.format("p_name")} AS g FROM d)
SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE), 9) AS similarity
FROM s a JOIN s b ON a.p_name < b.p_name WHERE len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE) >= 0.2""")
def trgm_similarity(spark, sf_dir):
    """All pairs of distinct titles at or above 0.20."""
    names = trigram_table(table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", "p_name")
    return similar_pairs(names, names, 0.2).where("a < b").select("a", "b", F.round("similarity", 9).alias("similarity"))


SEQUENCE = GRAMS.removeprefix("list_distinct(").removesuffix(")")
_hit = "len(list_intersect(g, seq[a:b]))"
SIM = f"""SELECT p_partkey, coalesce(list_max(flatten(list_transform(ps, lambda a: list_transform(list_filter(ps, lambda b: b >= a), lambda b: {_hit} / CAST(len(g) + len(list_distinct(seq[a:b])) - {_hit} AS DOUBLE))))), 0) AS sim
FROM (SELECT *, list_filter(range(1, len(seq) + 1), lambda i: list_contains(g, seq[i])) AS ps FROM (SELECT p_partkey, {SEQUENCE.format("(p_name || ' ' || p_brand || ' ' || p_type)")} AS seq, {GRAMS.format("'NEEDLE'")} AS g FROM part))"""


@query(f"""SELECT p_partkey, round(sim, 9) AS similarity FROM ({SIM.replace("NEEDLE", "blu smal")}) WHERE sim >= 0.3""")
def trgm_word_similarity(spark, sf_dir):
    """Best stretch of the text's trigrams against the needle's; the share of the needle's trigrams sorts texts out first."""
    needle = "blu smal"
    near = postings.with_share(gram_index(spark, sf_dir), grams_of(spark, needle), 0.3)
    docs = search_documents(spark, sf_dir).join(near, F.col("p_partkey") == F.col("key"))
    return docs.select("p_partkey", F.round(rank.word_similarity(F.lit(needle), F.col("all_text")), 9).alias("similarity")).where("similarity >= 0.3")


RANKED = COVER + f""", w AS ({SIM.replace("NEEDLE", "blue small")}),
m AS (SELECT p.p_partkey, round(coalesce(r.rank, 0) + 0.35 * w.sim, 6) AS score FROM part p JOIN w ON p.p_partkey = w.p_partkey LEFT JOIN r ON p.p_partkey = r.p_partkey WHERE p.p_size >= 10 AND (w.sim >= 0.6 OR r.rank IS NOT NULL))"""


@query(RANKED + """ SELECT p_partkey, score, (SELECT count(*) FROM m) AS total FROM m ORDER BY score DESC, p_partkey DESC LIMIT 20""")
def search_rank(spark, sf_dir):
    """Filters, match by words or by trigrams, rank plus 0.35 word similarity, top 20 with the total.

    Candidates come from the postings of the needle's tokens and trigrams: those with every token, and those with a
    share of the trigrams without which no stretch can be similar enough. Only their texts are read and ranked; hits
    are stored once, as the total counts all of them.
    """
    needle = " ".join(NEEDLE)
    words = postings.with_all(token_index(spark, sf_dir), NEEDLE).select("key", F.round(rank.cover_rank(F.col("tokens"), NEEDLE), 9).alias("cover"))
    near = postings.with_share(gram_index(spark, sf_dir), grams_of(spark, needle), 0.6)
    found = words.join(near, "key", "full")
    docs = search_documents(spark, sf_dir).where("p_size >= 10").join(found, F.col("p_partkey") == F.col("key")).withColumn("sim", rank.word_similarity(F.lit(needle), F.col("all_text")))
    score = F.round(F.coalesce("cover", F.lit(0.0)) + 0.35 * F.col("sim"), 6)
    hits = tables.stored(docs.where("cover IS NOT NULL OR sim >= 0.6").select("p_partkey", score.alias("score")), "search-hits")
    top = hits.orderBy(F.desc("score"), F.desc("p_partkey")).limit(20)
    return top.join(F.broadcast(hits.agg(F.count("*").alias("total"))), how="inner")  # one row


@query("""SELECT p_partkey FROM part WHERE p_size >= 45 ORDER BY p_partkey DESC LIMIT 50""")
def search_empty(spark, sf_dir):
    """A blank query: filters only, newest first."""
    return table(spark, sf_dir, "part").where("p_size >= 45").select("p_partkey").orderBy(F.desc("p_partkey")).limit(50)


@query("""SELECT 'scan of parts' AS step, true AS found UNION ALL SELECT 'filter reaches the scan', true UNION ALL SELECT 'only the columns in use are read', true""")
def search_explain(spark, sf_dir):
    """What the physical plan of the search says: the scan, its pushed filter, and its columns."""
    docs = search_documents(spark, sf_dir).where("p_size >= 10").where(rank.matches_all(F.col("tokens"), NEEDLE)).select("p_partkey")
    plan = docs._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    seen = [("scan of parts", "Scan parquet" in plan), ("filter reaches the scan", "GreaterThanOrEqual(p_size,10)" in plan), ("only the columns in use are read", "p_retailprice" not in plan)]
    return spark.createDataFrame(seen, "step string, found boolean")
