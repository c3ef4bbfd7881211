"""URL filters: host-suffix and path-prefix expressions, joined by short hash prefixes.

A rule has a host, a path and a verdict. It fits a URL whose host is the rule's
or a subdomain of it and whose path starts with the rule's. Every distinct URL
is expanded into expressions ``host suffix / path prefix``, for the shapes
(number of labels, length of path) that the rules have; an expression's SHA-256
is cut to ``PREFIX`` hex digits, which are equi-joined with those of the rules;
what meets there is confirmed by the full digests. Of the rules that fit, the
one with the longest ``host + path`` decides, then the longer host; of two
verdicts for one host and path ``block`` decides. Where none fits, the verdict
is ``default``.

Everything is DataFrame expressions. Distinct URLs are shuffled once and keep
that partitioning up to their verdict; the rows meet it by their URL, where
adaptive execution splits a hot one. Rules are broadcast up to ``BROADCAST_RULES``
(about 100 bytes each); beyond that their prefixes are joined by a shuffle with
``SALTS`` copies of each rule, since expressions such as ``com/`` occur in a third
of all rows. Rules of more than ``SHAPES`` shapes ask for every prefix of a path
up to their longest one instead.

Defined cases: null URLs and URLs without ``://`` have an empty host and path and
get the default; a URL with no path (``http://a.org?x``) has the empty one, which
starts with no rule but one without a path; ports and user names belong to the
host, as do trailing dots; very long URLs are read whole; repeated rows each get
their result; rules with a null in them, or with ``/``, ``?`` or ``#`` in their host,
never fit; no rules at all give every row the default; other columns go through,
and one named like a result gives way to it; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, row_of, with_results

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that are joined.
PREFIX = 8
BROADCAST_RULES = 500_000
SALTS = 16
SHAPES = 4096

# The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def digest_of(host: Column, path: Column) -> Column:
    """Hosts hold no ``/``, so that no two expressions read alike."""
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def _usable(rules: DataFrame) -> DataFrame:
    """(host, path, blocks) of the rules that can fit, each host and path once."""
    own = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", (F.col("verdict") == "block").alias("blocks"))
    return own.where("host IS NOT NULL AND path IS NOT NULL AND blocks IS NOT NULL").where(~F.col("host").rlike("[/?#]")).groupBy("host", "path").agg(F.max("blocks").alias("blocks"))


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Of (url, host, path) the expressions that a rule's shape can equal: url, suffix, start."""
    shapes = rules.select(labels_of(F.col("host")).alias("labels"), F.length("path").alias("chars")).distinct()
    found = [tuple(r) for r in shapes.limit(SHAPES + 1).collect()]
    if len(found) > SHAPES:
        most, longest = shapes.agg(F.max("labels"), F.max("chars")).first()
        each = urls.withColumn("labels", F.explode(F.sequence(F.lit(1), F.least(labels_of(F.col("host")), F.lit(most)))))
        each = each.withColumn("chars", F.explode(F.sequence(F.lit(0), F.least(F.length("path"), F.lit(longest)))))
    else:
        listed = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in sorted(found)]) if found else F.array().cast("array<struct<labels:int,chars:int>>")
        each = urls.withColumn("n_labels", labels_of(F.col("host"))).withColumn("n_chars", F.length("path"))
        each = each.withColumn("shape", F.explode(listed)).where("shape.labels <= n_labels AND shape.chars <= n_chars").select("url", "host", "path", "shape.labels", "shape.chars")
    return each.select("url", F.expr("substring_index(host, '.', -labels)").alias("suffix"), F.expr("substring(path, 1, chars)").alias("start"))


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, blocks of each distinct non-null URL that some rule fits."""
    known = _usable(rules)
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    known = known.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "blocks", digest_of(F.col("host"), F.col("path")).alias("rule_digest"))
    known = known.withColumn("prefix", F.substring("rule_digest", 1, PREFIX))
    asked = expressions(urls, _usable(rules)).select("url", digest_of(F.col("suffix"), F.col("start")).alias("digest"))
    asked = asked.withColumn("prefix", F.substring("digest", 1, PREFIX))
    if few:
        met = asked.join(F.broadcast(known), "prefix")
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        met = asked.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["prefix", "salt"])
    fits = met.where("digest = rule_digest")
    best = F.max(F.struct(F.length("rule").alias("chars"), "host_chars", "blocks", "rule")).alias("best")
    return fits.groupBy("url").agg(best).select("url", "best.rule", "best.blocks")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule and verdict."""
    rows = pages.select(row_of(pages).alias("row"), quoted(url).cast("string").alias("url"))
    distinct = rows.select("url").where("url IS NOT NULL").distinct()
    best = best_rules(distinct.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    out = rows.join(best, "url", "left").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    verdict = F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow").otherwise(default)
    return with_results(out.withColumn("verdict", verdict), pages, {"host": "host", "path": "path", "rule": "rule", "verdict": "verdict"})
