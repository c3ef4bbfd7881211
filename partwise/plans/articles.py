"""Documents with front matter, imports, embedded components and fences, and what is extracted from them.

Articles are composed from parts, of eight kinds by their key; Spark and the SQL beside it each parse the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.operators import markup
from partwise.plans.registry import query, table

KINDS = [
    "# {name} {k}\nA plain page about **{name}**.\n\nSecond paragraph.\n## Usage\n- one\ntext {k}",
    "---\ntitle: \"{name} {k}\"\ndescription: 'The [{name}](https://x.example/{k}) board'\nsku: S-{k}\n---\n# {name} {k}\nBody.",
    "---\ntitle: lost {k}\n# Heading {k}\nText after.",
    "---\n# comment\n\nno colon here\nBad Key!: x\nempty:\nref: &anchor\nTitle: Kept {k}\n---\n\nIntro line one\nline two\n\n| a | b |\n# Last {k}\n",
    "import X from 'y'\nexport default 1\n<Tabs groupId=\"a\">\n# Title {k} <b>bold</b>\n{`code`} shown {k}\nText with {expr} inside.\n</Tabs>",
    "# Fences {k}\n```\n# not a heading\n~~~\nout again {k}\n```\nhidden too\n~~~\nvisible {k}\n",
    "---\ntitle: {name}\ntitle: Second {k}\ntags: [a, b]\ndescription: !!bad\n---\n![pic](/i.png)\nFirst real {k}\n### Deep *em*\n- item",
    "\n\nJust a preamble {k}\r\nwith two lines\r\n\r\n# H {k}\r\n",
]


def articles(spark, sf_dir) -> DataFrame:
    """(p_partkey, text)"""
    text = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{name}"), F.col("p_name")).alias("text"))


def parts_of(articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata, text lines by section, and warnings (p_partkey, nth, warning) of (p_partkey, text)."""
    lines = markup.document_lines(articles, "p_partkey", F.col("text"))
    found, body = markup.metadata(lines), markup.body_lines(lines, "p_partkey")
    unclosed = lines.where("end = -1 AND line = 1").select("p_partkey", F.lit(0).cast("long").alias("at"), F.lit("frontmatter_unterminated").alias("warning"))
    code = body.groupBy("p_partkey").agg(F.max("ignored").alias("x")).where("x").select("p_partkey", F.lit(2**62).alias("at"), F.lit("executable_construct_ignored").alias("warning"))
    told = unclosed.unionByName(found.where("warning IS NOT NULL").select("p_partkey", F.col("line").alias("at"), "warning")).unionByName(code).groupBy("p_partkey", "warning").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("p_partkey").orderBy("at"))
    return found.where("warning IS NULL"), markup.document_sections(body, "p_partkey"), told.select("p_partkey", nth.cast("long").alias("nth"), "warning")


_texts = "[" + ", ".join("'" + x.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'" for x in KINDS) + "]"
_clean = lambda c: "trim(regexp_replace(" + "regexp_replace(" * 7 + c + r""", '!\[([^\]]*)\]\(([^)\s]+)\)', '', 'g'), '\[([^\]]+)\]\(([^)\s]+)\)', '\1', 'g'), '<[/!]?[A-Za-z][^>]*>', '', 'g'), '\{[^{}]*\}', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '[`~]', '', 'g'), '\s+', ' ', 'g'))"""
_head = r"'^#{1,6}\s+.+$'"
PARSED = rf"""
WITH a AS (SELECT p_partkey, regexp_replace(replace(replace({_texts}[1 + p_partkey % 8], '{{k}}', p_partkey::VARCHAR), '{{name}}', p_name), '\r\n', chr(10), 'g') AS text FROM part),
l0 AS (SELECT p_partkey, unnest(xs) AS body, unnest(range(1, len(xs) + 1)) AS line FROM (SELECT p_partkey, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS xs FROM (SELECT p_partkey, string_split(text, chr(10)) AS x FROM a))),
l AS (SELECT *, CASE WHEN NOT bool_or(line = 1 AND trim(body) = '---') OVER w THEN 0 ELSE coalesce(min(line) FILTER (WHERE line > 1 AND trim(body) = '---') OVER w, -1) END AS fin FROM l0 WINDOW w AS (PARTITION BY p_partkey)),
m0 AS (SELECT p_partkey, line, lower(trim(split_part(body, ':', 1))) AS name, trim(trim(substr(body, instr(body, ':') + 1)), '''"') AS value, instr(body, ':') = 0 AS bare FROM l WHERE line > 1 AND line < fin AND trim(body) <> '' AND NOT starts_with(ltrim(body), '#')),
m AS (SELECT p_partkey, line, name, {_clean("value")} AS value, CASE WHEN bare THEN 'frontmatter_entry_ignored' WHEN NOT regexp_full_match(name, '[a-z][a-z0-9_-]*') OR value = '' OR regexp_matches(value, '!!|&|\*') THEN 'frontmatter_value_ignored' END AS warning FROM m0),
b0 AS (SELECT *, regexp_matches(body, '^\s*(```|~~~)') AS fence FROM l WHERE line > greatest(fin, 0)),
b1 AS (SELECT *, fence OR sum(fence::INT) OVER (PARTITION BY p_partkey ORDER BY line) % 2 = 1 OR regexp_matches(body, '^\s*(import|export) ') AS hidden FROM b0),
b AS (SELECT *, hidden OR regexp_matches(body, '<[/!]?[A-Za-z][^>]*>|\{{[^{{}}]*\}}') AS ignored, regexp_replace(regexp_replace(body, '<[/!]?[A-Za-z][^>]*>', '', 'g'), '\{{[^{{}}]*\}}', '', 'g') AS txt FROM b1),
s0 AS (SELECT p_partkey, line, txt, regexp_matches(trim(txt), {_head}) AS hd FROM b WHERE NOT hidden),
s AS (SELECT *, CAST(sum(hd::INT) OVER w AS BIGINT) AS section, max(CASE WHEN hd THEN line END) OVER w AS hline FROM s0 WINDOW w AS (PARTITION BY p_partkey ORDER BY line)),
h AS (SELECT p_partkey, section, line AS hline, length(regexp_extract(trim(txt), '^(#+)', 1)) AS level, {_clean(r"regexp_extract(trim(txt), '^#+\s+(.+)$', 1)")} AS heading FROM s WHERE hd),
wn AS (SELECT p_partkey, warning, min(nat) AS nat FROM (SELECT p_partkey, 'frontmatter_unterminated' AS warning, 0 AS nat FROM l WHERE fin = -1 AND line = 1 UNION ALL SELECT p_partkey, warning, line FROM m WHERE warning IS NOT NULL UNION ALL SELECT DISTINCT p_partkey, 'executable_construct_ignored', 1000000 FROM b WHERE ignored) GROUP BY 1, 2),
q AS (SELECT *, hd OR trim(txt) = '' OR starts_with(trim(txt), '|') OR regexp_matches(trim(txt), '^[-*+]\s+.') OR regexp_matches(txt, '!\[[^\]]*\]\([^)\s]+\)') AS stops FROM s),
r AS (SELECT *, sum(stops::INT) OVER (PARTITION BY p_partkey ORDER BY line) AS run FROM q),
pg AS (SELECT * FROM (SELECT p_partkey, section, min(line) AS line, {_clean("string_agg(txt, ' ' ORDER BY line)")} AS value FROM r WHERE NOT stops GROUP BY p_partkey, section, run) WHERE value <> '')"""


@query(PARSED + """
SELECT p_partkey, 'metadata' AS kind, CAST(line AS BIGINT) AS line, 0 AS level, name, value FROM m WHERE warning IS NULL
UNION ALL SELECT p_partkey, 'warning', CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY nat) AS BIGINT), 0, warning, '' FROM wn
UNION ALL SELECT s.p_partkey, 'section', CAST(coalesce(any_value(h.hline), 0) AS BIGINT), coalesce(any_value(level), 0), any_value(heading), coalesce(string_agg(txt, '|' ORDER BY line) FILTER (WHERE NOT hd), '') FROM s LEFT JOIN h USING (p_partkey, section) GROUP BY s.p_partkey, s.section""")
def src_markdown_v2(spark, sf_dir):
    """A document as rows: metadata of the front matter, sections with their lines (the preamble has no heading), warnings in order."""
    fields, lines, told = parts_of(articles(spark, sf_dir))
    no = F.lit(0).alias("level")
    whole = lines.groupBy("p_partkey", "section").agg(F.max("heading_line").alias("at"), F.max("level").alias("level"), F.max("heading").alias("name"), F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("line", "text")))).alias("xs"))
    sections = whole.select("p_partkey", F.lit("section").alias("kind"), F.coalesce("at", F.lit(0)).alias("line"), "level", "name", F.array_join(F.transform("xs", lambda x: x["text"]), "|").alias("value"))
    meta = fields.select("p_partkey", F.lit("metadata").alias("kind"), "line", no, "name", "value")
    return meta.unionByName(told.select("p_partkey", F.lit("warning").alias("kind"), F.col("nth").alias("line"), no, F.col("warning").alias("name"), F.lit("").alias("value"))).unionByName(sections)


@query(PARSED + """ SELECT p_partkey, value AS title, CAST(min(line) AS BIGINT) AS line, count(*) AS n FROM (SELECT p_partkey, value, line FROM m WHERE warning IS NULL AND name = 'title' UNION ALL SELECT p_partkey, heading, hline FROM h WHERE level = 1) GROUP BY 1, 2""")
def ext_titles(spark, sf_dir):
    """Titles of the front matter, then first-level headings outside code; equal ones are one, with all their places counted."""
    fields, lines, _ = parts_of(articles(spark, sf_dir))
    heads = lines.where("is_heading AND level = 1").select("p_partkey", F.col("heading").alias("title"), "line")
    every = fields.where("name = 'title'").select("p_partkey", F.col("value").alias("title"), "line").unionByName(heads)
    return every.groupBy("p_partkey", "title").agg(F.min("line").alias("line"), F.count("*").alias("n"))


@query(PARSED + """, d AS (SELECT p_partkey, value, CAST(line AS BIGINT) AS line FROM m WHERE warning IS NULL AND name = 'description'),
f AS (SELECT p_partkey, coalesce(min(section) FILTER (WHERE level = 1), 0) AS section FROM (SELECT DISTINCT p_partkey, section, level FROM s LEFT JOIN h USING (p_partkey, section)) GROUP BY 1),
i AS (SELECT p_partkey, min_by(value, line) AS value, CAST(min(line) AS BIGINT) AS line FROM pg JOIN f USING (p_partkey, section) GROUP BY 1)
SELECT p_partkey, value AS summary, line FROM d UNION ALL SELECT p_partkey, value, line FROM i WHERE p_partkey NOT IN (SELECT p_partkey FROM d)""")
def ext_summaries(spark, sf_dir):
    """Descriptions of the front matter; without one, the first paragraph of the first first-level section, or of the preamble where there is none."""
    fields, lines, _ = parts_of(articles(spark, sf_dir))
    described = fields.where("name = 'description'").select("p_partkey", F.col("value").alias("summary"), "line")
    first = lines.groupBy("p_partkey").agg(F.coalesce(F.min(F.when(F.col("level") == 1, F.col("section"))), F.lit(0)).alias("section"))
    paragraphs = markup.document_paragraphs(lines, "p_partkey").join(first, ["p_partkey", "section"])
    intro = paragraphs.groupBy("p_partkey").agg(F.min_by("value", "line").alias("summary"), F.min("line").alias("line"))
    return described.unionByName(intro.join(described.select("p_partkey"), "p_partkey", "left_anti").select("p_partkey", "summary", "line"))
