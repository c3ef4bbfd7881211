"""Extraction from the composed component pages (the given texts hold no such marks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import markup
from partwise.plans import components, normalize
from partwise.plans.components import N, page_rows, sql_text
from partwise.plans.registry import query

_k = lambda c: f"replace(replace({c}, '{{k}}', p_partkey::VARCHAR), '{{brand}}', p_brand)"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    shown = ", ".join("(" + ", ".join(sql_text(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return f"WITH {name}(shape, {columns}) AS (VALUES {shown}) "


_each = list(enumerate(components.SHAPES))
_items = [(i, kind, x) for i, s in _each for kind in ("features", "applications") for x in s.get(kind, [])] + [(i, "resources", f"[{a}]({b})") for i, s in _each for a, b in s.get("resources", [])]
_ids = [(i, {**dict(markup.IDENTIFIER_LABELS), "manufacturer": "manufacturer"}[a.lower()], b) for i, s in _each for a, b in s.get("ids", [])]
_places = [(i, line.split(":")[0], n) for i, s in _each for n, line in enumerate(components.page_text(s).split("\n"), 1) if ": " in line and line != "Manufacturer: not a fact"]
_outside = [(i, s["title"], len([x for x in components.page_text(s).split("\n")]) - 3 - sum(x.startswith("#") for x in components.page_text(s).split("\n")) + 1) for i, s in _each]


@query(f"""SELECT p_partkey, 'photo' AS alt, '/img/' || p_partkey || '.png' AS target FROM part""")
def ext_images(spark, sf_dir):
    return markup.images(page_rows(spark, sf_dir)).select("p_partkey", "alt", "target")


@query(_values("v", "kind, item", _items) + f"SELECT p_partkey, kind AS section_kind, {_k('item')} AS item FROM part JOIN v ON p_partkey % {N} = shape")
def ext_lists(spark, sf_dir):
    """List items with the kind of their section."""
    return markup.list_items(page_rows(spark, sf_dir)).select("p_partkey", F.col("kind").alias("section_kind"), "item")


@query(f"WITH {components.SPEC_ROWS} SELECT p_partkey, label, {_k('value')} AS value FROM part JOIN sp ON p_partkey % {N} = shape")
def ext_specs(spark, sf_dir):
    """Two-column rows of specification sections, header skipped."""
    cells = markup.table_cells(page_rows(spark, sf_dir), "p_partkey").where("kind = 'specifications' AND size(cells) = 2")
    return cells.select("p_partkey", F.get("cells", F.lit(0)).alias("label"), F.get("cells", F.lit(1)).alias("value"))


@query(_values("v", "number, name", [(i, str(n), p) for i, s in _each for n, p in enumerate(s.get("pins", []), 1)]) + f"SELECT p_partkey, number, name, 'signal' AS function FROM part JOIN v ON p_partkey % {N} = shape")
def ext_pinout(spark, sf_dir):
    cells = markup.table_cells(page_rows(spark, sf_dir), "p_partkey").where("kind = 'pinout' AND size(cells) = 3")
    return cells.select("p_partkey", F.get("cells", F.lit(0)).alias("number"), F.get("cells", F.lit(1)).alias("name"), F.get("cells", F.lit(2)).alias("function"))


@query(_values("v", "kind, value", _ids) + f"SELECT p_partkey, kind, {_k('value')} AS value FROM part JOIN v ON p_partkey % {N} = shape")
def ext_identifiers(spark, sf_dir):
    """Label dictionary look-ups; fenced lines are no facts."""
    return markup.identifiers(page_rows(spark, sf_dir).drop("kind")).select("p_partkey", "kind", "value")


@query(_values("v", "label, line", _places) + f"SELECT p_partkey, label, CAST(line AS INTEGER) AS line FROM part JOIN v ON p_partkey % {N} = shape")
def ext_labels(spark, sf_dir):
    """Labelled lines with their place."""
    return markup.key_values(page_rows(spark, sf_dir)).where("NOT contains(body, '|')").select("p_partkey", "label", F.col("line").cast("int").alias("line"))


@query(_values("v", "title, n", _outside) + f"SELECT p_partkey, {_k('title')} AS title, CAST(n AS BIGINT) AS n_lines FROM part JOIN v ON p_partkey % {N} = shape")
def src_markdown_v1(spark, sf_dir):
    """The older reader: title and number of lines outside fences, later headings left out."""
    rows = page_rows(spark, sf_dir)
    title = F.max(F.when(F.col("is_heading") & (F.col("section") == 1), F.col("heading")))
    return rows.groupBy("p_partkey").agg(title.alias("title"), F.count_if(~F.col("is_heading") | (F.col("section") == 1)).alias("n_lines"))


_field = lambda kind: f"(SELECT {_k('value')} FROM v WHERE v.shape = p_partkey % {N} AND v.kind = '{kind}')"
_wiki = _values("v", "kind, value", _ids).rstrip() + f", {components.SHAPE_ROWS}, w AS (SELECT p_partkey, p_brand, shape, {_k('title')} AS title, {_field('manufacturer')} AS manufacturer, coalesce({_field('part_number')}, {_field('model')}, {_field('sku')}, {_field('product_id')}) AS mpn FROM part JOIN sh ON p_partkey % {N} = shape) "


@query(_wiki + "SELECT p_partkey, title, manufacturer, mpn FROM w")
def src_wiki_v1(spark, sf_dir):
    """A page as one row of fields; the first identifier by rank is its number."""
    rows = components.facts(spark, sf_dir)
    of = lambda kind: F.get(F.transform(F.filter("ids", lambda i: i["kind"] == kind), lambda i: i["value"]), F.lit(0))
    return rows.select("p_partkey", F.col("titles")[0].alias("title"), "manufacturer", F.coalesce(*map(of, ("part_number", "model", "sku", "product_id"))).alias("mpn"))


@query(
    f"{_wiki}, {normalize.SPECS.removeprefix(components.SHAPE_ROWS + ', ')}"
    + """, c AS (SELECT sh.shape, (SELECT count(*) FROM nv WHERE nv.shape = sh.shape AND path IS NOT NULL) AS mapped, (SELECT count(*) FROM nv WHERE nv.shape = sh.shape AND path IS NULL) AS unmapped, n_pins, len(features) AS nf, profile, n_resources FROM sh JOIN prof USING (shape))
SELECT p_partkey, '{"features":' || nf || coalesce(',"manufacturer":"' || manufacturer || '"', '') || coalesce(',"mpn":"' || mpn || '"', '') || ',"pins":' || n_pins || ',"profile":"' || profile || '","resources":' || n_resources || ',"specs":' || mapped || ',"title":"' || title || '","unmapped":' || unmapped || '}' AS legacy FROM w JOIN c USING (shape)"""
)
def comp_legacy_map(spark, sf_dir):
    """The composed draft in the older flat form: fields in alphabetical order, absent ones left out."""
    fields = normalize.facts(spark, sf_dir).select("p_partkey", "profile", "n_mapped", "n_unmapped", "n_pins", F.size("features").alias("features"), F.size("resources").alias("resources"))
    rows = src_wiki_v1(spark, sf_dir).join(fields, "p_partkey")
    flat = F.struct("features", "manufacturer", "mpn", F.col("n_pins").alias("pins"), "profile", "resources", F.col("n_mapped").alias("specs"), "title", F.col("n_unmapped").alias("unmapped"))
    return rows.select("p_partkey", F.to_json(flat).alias("legacy"))
