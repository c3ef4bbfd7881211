"""Fact extraction from pages, with the place of every fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import markup
from partwise.plans.registry import query, table

# The same page reading in DuckDB (global replacement, RE2).
MD = "html"
for _p, _n in (("(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), ('<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[\\2](\\1)"), ("<h1[^>]*>", "\n# "), ("<h[2-6][^>]*>", "\n## "), ("<li[^>]*>", "\n- "), ("<(p|div|nav|ul|table|tr)[^>]*>", "\n"), ("<[^>]+>", "")):
    MD = f"regexp_replace({MD}, '{_p}', '{_n}', 'g')"
LINES = f"""l AS (SELECT page_id, CAST(i AS BIGINT) AS line, s[i] AS body FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, string_split({MD}, '\n') AS s FROM pages)))"""
SECTIONS = LINES + """, x AS (SELECT page_id, line, body, regexp_matches(body, '^#{1,6}\\s+') AS is_heading FROM l),
s AS (SELECT *, CAST(sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line) AS BIGINT) AS section FROM x)"""


def page_lines(spark, sf_dir):
    return markup.lines(table(spark, sf_dir, "pages"), "page_id", markup.page_markdown(F.col("html")))


def page_sections(spark, sf_dir):
    return markup.sections(page_lines(spark, sf_dir), "page_id")


@query(f"WITH {LINES} SELECT page_id, line, 'unknown' AS kind FROM l WHERE regexp_matches(body, '^#{{1,6}}\\s+') AND trim(regexp_replace(lower(regexp_extract(body, '^(#{{1,6}})\\s+(.*)$', 2)), '[^a-z0-9]+', ' ', 'g')) NOT IN ('features', 'overview', 'description', 'usage', 'resources', 'pins', 'pinout', 'applications')")
def ext_sections(spark, sf_dir):
    """Heading to section kind; unknown headings are kept."""
    heads = page_sections(spark, sf_dir).where("is_heading")
    return heads.select("page_id", "line", markup.section_kind(F.col("heading")).alias("kind"))


@query(f"WITH {LINES} SELECT page_id, line, trim(regexp_extract(body, '^\\s*(?:[-*+]|[0-9]+[.)])\\s+(.*)$', 1)) AS item FROM l WHERE trim(regexp_extract(body, '^\\s*(?:[-*+]|[0-9]+[.)])\\s+(.*)$', 1)) <> ''")
def ext_list_items(spark, sf_dir):
    return markup.list_items(page_lines(spark, sf_dir)).select("page_id", "line", "item")


@query(f"WITH {LINES}, k AS (SELECT page_id, line, trim(regexp_extract(body, '^\\s*(?:[-*+]\\s+)?([^:|]{{1,60}}):\\s+(.+)$', 1)) AS label, trim(regexp_extract(body, '^\\s*(?:[-*+]\\s+)?([^:|]{{1,60}}):\\s+(.+)$', 2)) AS value FROM (SELECT page_id, line, 'id ' || page_id || ': ' || body AS body FROM l WHERE starts_with(body, '# '))) SELECT page_id, line, label, value FROM k WHERE label <> '' AND value <> ''")
def ext_key_values(spark, sf_dir):
    """``label: value`` lines (made here from headings, as the pages have none)."""
    made = page_lines(spark, sf_dir).where(F.startswith("body", F.lit("# "))).withColumn("body", F.concat(F.lit("id "), F.col("page_id"), F.lit(": "), F.col("body")))
    return markup.key_values(made).select("page_id", "line", "label", "value")


@query(f"WITH {LINES}, k AS (SELECT page_id, line, unnest(regexp_extract_all(body, '\\[([^\\]]*)\\]\\(([^)\\s]+)[^)]*\\)')) AS raw FROM l) SELECT page_id, line, regexp_extract(raw, '\\[([^\\]]*)\\]', 1) AS label, regexp_extract(raw, '\\]\\(([^)\\s]+)', 1) AS target FROM k")
def ext_links(spark, sf_dir):
    return markup.links(page_lines(spark, sf_dir)).select("page_id", "line", "label", "target")


@query(f"WITH {LINES}, k AS (SELECT page_id, unnest(regexp_extract_all(body, '\\[([^\\]]*)\\]\\(([^)\\s]+)[^)]*\\)')) AS raw FROM l) SELECT page_id, CASE WHEN contains(lower(raw), 'datasheet') THEN 'datasheet' WHEN contains(lower(raw), 'schematic') THEN 'schematic' WHEN contains(lower(raw), 'librar') THEN 'library' WHEN regexp_matches(lower(raw), 'github|gitlab') THEN 'repository' ELSE 'link' END AS kind, count(*) AS n FROM k GROUP BY 1, 2")
def ext_resources(spark, sf_dir):
    """Link kinds by the first keyword that fits."""
    found = markup.links(page_lines(spark, sf_dir))
    return found.groupBy("page_id", markup.resource_kind(F.col("label"), F.col("target")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {SECTIONS} SELECT page_id, concat_ws(',', CASE WHEN count(*) FILTER (WHERE is_heading) = 0 THEN 'title_missing' END, CASE WHEN count(*) FILTER (WHERE regexp_matches(body, '^\\s*(?:[-*+]|[0-9]+[.)])\\s+.')) = 0 THEN 'lists_missing' END, CASE WHEN count(*) FILTER (WHERE contains(body, '|')) = 0 THEN 'tables_missing' END) AS warnings FROM s GROUP BY page_id")
def ext_warnings(spark, sf_dir):
    """Absence codes of a page."""
    rows = page_sections(spark, sf_dir)
    has = {"title_missing": F.col("is_heading"), "lists_missing": F.col("body").rlike(r"^\s*(?:[-*+]|[0-9]+[.)])\s+."), "tables_missing": F.contains("body", F.lit("|"))}
    counted = rows.groupBy("page_id").agg(*[F.count_if(c).alias(code) for code, c in has.items()])
    return counted.select("page_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(code) == 0, F.lit(code)) for code in has])), ",").alias("warnings"))


@query(f"WITH {LINES} SELECT page_id, 'line[' || line || ']' AS selector, body AS raw_text, 'heading' AS method FROM l WHERE regexp_matches(body, '^#\\s+')")
def ext_evidence(spark, sf_dir):
    heads = page_sections(spark, sf_dir).where(F.col("body").rlike("^#\\s+"))
    found = markup.evidence(F.col("page_id").cast("string"), F.col("line"), F.col("heading"), F.col("body"), "heading")
    return heads.select("page_id", found.alias("e")).select("page_id", "e.selector", "e.raw_text", "e.method")


@query(f"WITH {SECTIONS}, p AS (SELECT page_id, section, trim(body) AS t, line FROM s WHERE NOT is_heading AND trim(body) <> '') SELECT page_id, section, count(*) AS n_fragments, string_agg(CASE WHEN starts_with(t, '- ') THEN 'item' ELSE 'text' END, ',' ORDER BY line) AS kinds FROM p GROUP BY 1, 2")
def ext_text_sections(spark, sf_dir):
    """The fragments of a section in order."""
    rows = page_sections(spark, sf_dir).where(~F.col("is_heading") & (F.trim("body") != ""))
    kind = F.when(F.startswith(F.trim("body"), F.lit("- ")), "item").otherwise("text")
    ordered = F.sort_array(F.collect_list(F.struct("line", kind.alias("kind"))))
    return rows.groupBy("page_id", "section").agg(F.count("*").alias("n_fragments"), F.array_join(F.transform(ordered, lambda x: x["kind"]), ",").alias("kinds"))


@query("""SELECT doc_id, regexp_extract(text, '[Ll]icensed under (?:the )?([A-Z][A-Za-z-]+)', 1) AS mention FROM documents WHERE regexp_matches(text, '[Ll]icensed under (?:the )?([A-Z][A-Za-z-]+)')""")
def ext_primary_ic(spark, sf_dir):
    """A named thing after a phrase (here: what a text is licensed under)."""
    pattern = "[Ll]icensed under (?:the )?([A-Z][A-Za-z-]+)"
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 1).alias("mention"))
