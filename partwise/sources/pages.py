"""Web pages: URL policy, metadata and per-site outcome as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED_SUFFIXES = (r"\.md$", r"\.mdx$", r"\.parquet$")
HEADING = "<h1[^>]*>([^<]*)</h1>"


def url_policy_columns(url: Column) -> tuple[Column, Column, Column]:
    """Verdict (first failing rule or ok), lower-case host, path without a trailing slash."""
    verdict = (
        F.when(~url.rlike("^[a-z]+://"), "malformed")
        .when(~F.startswith(url, F.lit("https://")), "scheme")
        .when(url.rlike("^[a-z]+://[^/]*@"), "credentials")
        .when(url.rlike("^[a-z]+://[^/:]+:[0-9]+"), "port")
        .when(F.contains(url, F.lit("#")), "fragment")
        .otherwise("ok")
    )
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)), "/+$", "")
    return verdict, host, F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """title, heading and a drift code for pages without a canonical link or description."""
    drift = (
        F.when(~F.col("html").rlike('<link[^>]+rel="canonical"'), "canonical_missing")
        .when(~F.col("html").rlike('<meta[^>]+name="description"'), "description_missing")
        .otherwise("ok")
    )
    return pages.withColumns({"title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "heading": F.regexp_extract("html", HEADING, 1), "drift": drift})


def site_outcome(pages: DataFrame) -> DataFrame:
    """The parser that a page's host selects and what it would report."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    parser = F.coalesce(*[F.when(F.endswith(F.col("host"), F.lit(f".{s}")), s) for s in ("com", "org", "net")], F.lit("none"))
    outcome = (
        F.when(F.col("parser") == "none", "host_not_allowed")
        .when(F.regexp_extract("html", HEADING, 1) == "", "heading_missing")
        .when(F.regexp_extract("html", "<p>([^<]*)", 1) == "", "body_missing")
        .otherwise("ok")
    )
    return pages.withColumn("host", host).withColumn("parser", parser).select("page_id", "parser", outcome.alias("outcome"))
