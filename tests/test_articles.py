"""Front matter, imports, tags and fences of either kind, case by case."""

from pyspark.sql import functions as F

from partwise.operators import markup
from partwise.plans import articles
from partwise.plans import catalogue  # noqa: F401


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "p_partkey long, text string")
    fields, lines, told = articles.parts_of(df)
    out = {i: {"fields": [], "lines": [], "warnings": []} for i in range(len(texts))}
    for r in fields.orderBy("line").collect():
        out[r.p_partkey]["fields"].append((r.line, r["name"], r.value))
    for r in lines.orderBy("line").collect():
        out[r.p_partkey]["lines"].append((r.line, r.section, r.level, r.heading, None if r.is_heading else r.text))
    for r in told.orderBy("nth").collect():
        out[r.p_partkey]["warnings"].append(r.warning)
    return [out[i] for i in range(len(texts))]


def test_front_matter(spark):
    ended, unended, late, odd, empty, none = parsed(
        spark, "---\nTitle: 'A `b`'\nsku:\t\"S: 1\"\n---\nbody", "---\ntitle: x\nbody", "\n---\ntitle: x\n---", "---\n: v\n1a: v\nok_key-2: v\nk: a & b\nk: '\"'\nword\n # note: x\n---", "", None
    )
    assert ended["fields"] == [(2, "title", "A b"), (3, "sku", "S: 1")] and ended["lines"] == [(5, 0, 0, None, "body")] and ended["warnings"] == []
    assert unended["fields"] == [] and [x[-1] for x in unended["lines"]] == ["---", "title: x", "body"] and unended["warnings"] == ["frontmatter_unterminated"]
    assert late["fields"] == [] and len(late["lines"]) == 4 and late["warnings"] == []
    assert odd["fields"] == [(4, "ok_key-2", "v")] and odd["warnings"] == ["frontmatter_value_ignored", "frontmatter_entry_ignored"]
    assert empty == none == {"fields": [], "lines": [], "warnings": []}


def test_code_imports_and_tags(spark):
    mixed, clean = parsed(spark, "import a\nimporting is text\n  export x\n~~~py\n# no\n```\n<B>in</B> {x} out\n## Two *words*\n```\nlost", "# One\r\ntext\x0cmore end\r\n")
    assert mixed["lines"] == [(2, 0, 0, None, "importing is text"), (7, 0, 0, None, "in  out"), (8, 1, 2, "Two words", None)]
    assert mixed["warnings"] == ["executable_construct_ignored"]
    assert clean["lines"] == [(1, 1, 1, "One", None), (2, 1, 1, "One", "text"), (3, 1, 1, "One", "more"), (4, 1, 1, "One", "end")] and clean["warnings"] == []


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n![x](y)\n| t |\n- item\n{gone}\n\nc [d](e)\n# H\nf")], "p_partkey long, text string")
    rows = markup.document_paragraphs(articles.parts_of(df)[1], "p_partkey").orderBy("line").collect()
    assert [(r.section, r.line, r.value) for r in rows] == [(0, 1, "a b"), (0, 9, "c d"), (1, 11, "f")]
    assert markup.document_lines(df.limit(0), "p_partkey", F.col("text")).count() == 0
