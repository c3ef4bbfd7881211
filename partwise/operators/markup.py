"""Lines, sections and fragments of marked-up text, one row each.

``lines`` splits texts; ``sections`` numbers them by headings, leaves fenced
code out and keeps line numbers, so that every fact can name its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Section kinds by heading words.
SECTION_KINDS = {
    "description": ["about", "description", "introduction", "overview", "product description", "what is it"],
    "features": ["feature", "features", "key features", "highlights"],
    "applications": ["application", "applications", "use cases", "typical applications"],
    "specifications": ["parameters", "specification", "specifications", "technical specifications"],
    "hardware": ["hardware", "hardware description", "hardware overview", "hardware structure"],
    "pinout": ["pin definition", "pin map", "pinout", "pins"],
    "usage": ["getting started", "getting started with arduino", "how to use", "play with arduino", "usage"],
    "resources": ["documents", "downloads", "references", "resource", "resources"],
    "identity": ["part list", "product data", "product information"],
}
# Labels of identifiers.
IDENTIFIER_LABELS = [("sku", "sku"), ("model", "model"), ("model number", "model"), ("part number", "part_number"), ("part no", "part_number"), ("product id", "product_id"), ("brand", "brand"), ("product family", "brand")]
ITEM = r"^\s*(?:[-*+]|[0-9]+[.)])\s+(.*)$"
PAIR = r"^\s*(?:[-*+]\s+)?([^:|]{1,60}):\s+(.+)$"
LINK = r"(?<!!)\[([^\]]*)\]\(([^)\s]+)"


def page_markdown(html: Column) -> Column:
    """Pages as Markdown lines: headings, list items, paragraphs, links."""
    c = html
    for pattern, new in (
        (r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), (r"<a [^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>", "[$2]($1)"), (r"<h1[^>]*>", "\n# "), (r"<h[2-6][^>]*>", "\n## "),
        (r"<li[^>]*>", "\n- "), (r"<(p|div|nav|ul|table|tr)[^>]*>", "\n"), (r"<[^>]+>", ""),
    ):
        c = F.regexp_replace(c, pattern, new)
    return c


def lines(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, line, body): line numbers from 1."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "body")).select(key, (F.col("n") + 1).cast("long").alias("line"), "body")


def sections(rows: DataFrame, key: str) -> DataFrame:
    """Lines outside fences with their section number and heading (0 and null before the first)."""
    by = Window.partitionBy(key).orderBy("line")
    fence = F.col("body").rlike("^\\s*```")
    heading = F.regexp_extract("body", "^(#{1,6})\\s+(.*)$", 2)
    rows = rows.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(by)).where(~fence & (F.col("fences") % 2 == 0)).drop("fences")
    rows = rows.withColumn("is_heading", F.col("body").rlike("^#{1,6}\\s+")).withColumn("heading", F.when(F.col("is_heading"), F.trim(heading)))
    return rows.withColumn("section", F.sum(F.when(F.col("is_heading"), 1).otherwise(0)).over(by)).withColumn("heading", F.last("heading", ignorenulls=True).over(by))


def section_kind(heading: Column) -> Column:
    name = F.trim(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", " "))
    return F.coalesce(*[F.when(name.isin(words), F.lit(kind)) for kind, words in SECTION_KINDS.items()], F.lit("unknown"))


def list_items(rows: DataFrame) -> DataFrame:
    return rows.withColumn("item", F.trim(F.regexp_extract("body", ITEM, 1))).where("item <> ''")


def key_values(rows: DataFrame) -> DataFrame:
    """``label: value`` lines and two-column table rows (separator rows go)."""
    pair = F.regexp_extract("body", PAIR, 1), F.regexp_extract("body", PAIR, 2)
    cell = F.regexp_extract("body", r"^\s*\|([^|]+)\|([^|]+)\|\s*$", 1), F.regexp_extract("body", r"^\s*\|([^|]+)\|([^|]+)\|\s*$", 2)
    out = rows.withColumn("label", F.trim(F.coalesce(F.nullif(cell[0], F.lit("")), pair[0]))).withColumn("value", F.trim(F.coalesce(F.nullif(cell[1], F.lit("")), pair[1])))
    return out.where("label <> '' AND value <> ''").where(~F.col("label").rlike("^:?-+:?$"))


def links(rows: DataFrame) -> DataFrame:
    """One row per link that isn't an image, in order."""
    found = F.regexp_extract_all("body", F.lit(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), F.lit(0))
    out = rows.select("*", F.posexplode(found).alias("nth", "raw"))
    return out.withColumn("label", F.regexp_extract("raw", r"\[([^\]]*)\]", 1)).withColumn("target", F.regexp_extract("raw", r"\]\(([^)\s]+)", 1))


def resource_kind(label: Column, target: Column) -> Column:
    text = F.lower(F.concat_ws(" ", label, target))
    return F.when(F.contains(text, F.lit("datasheet")), "datasheet").when(F.contains(text, F.lit("schematic")), "schematic").when(F.contains(text, F.lit("librar")), "library").when(text.rlike(r"github|gitlab"), "repository").otherwise("link")


def evidence(source: Column, line: Column, heading: Column, raw: Column, method: str, version: str = "1") -> Column:
    """Where a fact comes from."""
    return F.struct(source.alias("source"), F.concat(F.lit("line["), line, F.lit("]")).alias("selector"), heading.alias("section"), raw.alias("raw_text"), F.lit(method).alias("method"), F.lit(version).alias("version"))


def with_cells(rows: DataFrame, key: str) -> DataFrame:
    """All lines, those of pipe tables with their ``cells`` (header rows, which a separator follows, and separators have none)."""
    by = Window.partitionBy(key).orderBy("line")
    separator = r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"
    marked = rows.withColumn("_sep", F.col("body").rlike(separator)).withColumn("_head", F.lead("_sep", 1, False).over(by))
    inner = F.regexp_replace(F.trim("body"), r"^\||\|$", "")
    cells = F.when(F.col("body").rlike(r"^\s*\|.*\|\s*$") & ~F.col("_sep") & ~F.col("_head"), F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)))
    return marked.withColumn("cells", cells).drop("_sep", "_head")


def table_cells(rows: DataFrame, key: str) -> DataFrame:
    """Rows of pipe tables as arrays of cells, without header and separator rows."""
    return with_cells(rows, key).where(F.col("cells").isNotNull())


def images(rows: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("body", F.lit(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), F.lit(0))
    out = rows.select("*", F.explode(found).alias("raw"))
    return out.withColumn("alt", F.regexp_extract("raw", r"!\[([^\]]*)\]", 1)).withColumn("target", F.regexp_extract("raw", r"\]\(([^)\s]+)", 1))


def identifiers(rows: DataFrame) -> DataFrame:
    """Label/value facts whose label is in the dictionary, with the kind that it names."""
    label = F.trim(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", " "))
    kind = F.coalesce(*[F.when(label == name, F.lit(k)) for name, k in IDENTIFIER_LABELS], F.when(label.isin("manufacturer", "manufacturer name"), F.lit("manufacturer")))
    return key_values(rows).withColumn("kind", kind).where(F.col("kind").isNotNull())


# Documents with front matter, imports and embedded components.

def _strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


NEWLINE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
TAG, EXPRESSION = r"<[/!]?[A-Za-z][^>]*>", r"\{[^{}]{0,2000}\}"


def clean_markup(c: Column) -> Column:
    """A text without images, tags, expressions and marks of emphasis; links keep their label; space collapses."""
    for pattern, new in (
        (r"!\[([^\]]*)\]\(([^)\s]+)\)", ""), (r"(?<!!)\[([^\]]+)\]\(([^)\s]+)\)", "$1"), (TAG, ""), (EXPRESSION, ""), (r"\*\*([^*]+)\*\*", "$1"), (r"(?<!\*)\*([^*]+)\*(?!\*)", "$1"),
        (r"(?<!\w)__([^_]+)__(?!\w)", "$1"), (r"(?<!\w)_([^_]+)_(?!\w)", "$1"), ("[`~]", ""), (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, new)
    return _strip(c)


def document_lines(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, line, body, end): the lines of every text; ``end``: the line that closes its front matter, 0 without one, -1 if it is never closed.

    Null and empty texts have no lines; a last line break begins no line.
    """
    pieces = F.split(text, NEWLINE)
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    rows = df.select(key, F.posexplode(kept).alias("n", "body")).select(key, (F.col("n") + 1).cast("long").alias("line"), "body")
    by, mark = Window.partitionBy(key), _strip("body") == "---"
    opened = F.max((F.col("line") == 1) & mark).over(by)
    closed = F.min(F.when((F.col("line") > 1) & mark, F.col("line"))).over(by)
    return rows.withColumn("end", F.when(~opened, 0).otherwise(F.coalesce(closed, F.lit(-1))).cast("long"))


def metadata(rows: DataFrame) -> DataFrame:
    """(.., name, value, warning) for the entries of the front matter: a value, or why the line is ignored; comments and blank lines are neither."""
    own = rows.where((F.col("line") > 1) & (F.col("line") < F.col("end"))).where((_strip("body") != "") & ~_strip("body").startswith("#"))
    at = F.instr("body", ":")
    name = F.lower(_strip(F.substr("body", F.lit(1), at - 1)))
    value = F.btrim(_strip(F.substr("body", at + 1)), F.lit("'\""))
    bad = ~name.rlike("^[a-z][a-z0-9_-]{0,63}$") | (value == "") | value.rlike(r"!!|&|\*")
    warning = F.when(at == 0, "frontmatter_entry_ignored").when(bad, "frontmatter_value_ignored")
    return own.withColumn("warning", warning).withColumn("name", F.when(warning.isNull(), name)).withColumn("value", F.when(warning.isNull(), clean_markup(value)))


def body_lines(rows: DataFrame, key: str) -> DataFrame:
    """The lines after the front matter that are text: (.., text, ignored), ``text`` null where a line is code, an import or an export.

    Fences of either kind open and close one another; tags and expressions go, and count as ``ignored`` too.
    """
    by = Window.partitionBy(key).orderBy("line")
    fence, module = F.col("body").rlike(r"^\s*(```|~~~)"), F.col("body").rlike(r"^\s*(import|export) ")
    own = rows.where(F.col("line") > F.greatest("end", F.lit(0))).withColumn("_inside", F.sum(fence.cast("int")).over(by) % 2 == 1)
    hidden = fence | F.col("_inside") | module
    text = F.regexp_replace(F.regexp_replace("body", TAG, ""), EXPRESSION, "")
    return own.withColumn("ignored", hidden | F.col("body").rlike(TAG) | F.col("body").rlike(EXPRESSION)).withColumn("text", F.when(~hidden, text)).drop("_inside")


def document_sections(rows: DataFrame, key: str) -> DataFrame:
    """Text lines with their section: (.., section, level, heading, heading_line); section 0 is what comes before the first heading, headings are no lines of their own."""
    by, pattern = Window.partitionBy(key).orderBy("line"), r"^(#{1,6})\s+(.+?)\s*$"
    own = rows.where("text IS NOT NULL").withColumn("_head", _strip("text").rlike(pattern))
    head = lambda value: F.last(F.when(F.col("_head"), value), ignorenulls=True).over(by)
    out = own.withColumn("section", F.sum(F.col("_head").cast("int")).over(by)).withColumns({
        "level": F.coalesce(head(F.length(F.regexp_extract(_strip("text"), pattern, 1))), F.lit(0)), "heading": head(clean_markup(F.regexp_extract(_strip("text"), pattern, 2))), "heading_line": head(F.col("line")),
    })
    return out.withColumnRenamed("_head", "is_heading")


def document_paragraphs(rows: DataFrame, key: str) -> DataFrame:
    """(key, section, line, value) of the paragraphs of sections: runs of lines between blanks, table rows, items, pictures and headings."""
    by = Window.partitionBy(key).orderBy("line")
    t = _strip("text")
    stops = F.col("is_heading") | (t == "") | t.startswith("|") | t.rlike(r"^\s*[-*+]\s+(.+?)\s*$") | t.rlike(r"!\[([^\]]*)\]\(([^)\s]+)\)")
    runs = rows.withColumn("_stop", stops).withColumn("_run", F.sum(F.col("_stop").cast("int")).over(by)).where(~F.col("_stop"))
    whole = runs.groupBy(key, "section", "_run").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("xs"))
    out = whole.select(key, "section", F.get("xs", F.lit(0))["line"].alias("line"), clean_markup(F.array_join(F.transform("xs", lambda x: x["text"]), " ")).alias("value"))
    return out.where("value <> ''")
