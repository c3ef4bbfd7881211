"""Composed component pages: one Markdown page per part, of twelve shapes, and the facts parsed from it.

The given tables hold no component pages. ``SHAPES`` says what a page of each
shape holds; ``page_text`` writes it as Markdown, the plans parse that text, and
the SQL beside them works on the recipe itself (``VALUES`` below). A part's shape
is its key modulo twelve, ``{k}`` stands for its key and ``{brand}`` for its brand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import spaced_key
from partwise.operators import markup
from partwise.plans.registry import table

URL = "https://files.example.com/ds/"
SHAPES: list[dict] = [
    dict(title="Grove Temperature Sensor {k}", summary="A temperature and humidity sensing module based on BME{k} for I2C.", description=("Overview", "It measures air temperature in a wide measurement range."), features=["High accuracy", "Low power"], applications=["Weather stations"], usage=("Getting Started", "Connect the module and open the sketch."), specs=[("Specification", [("Operating voltage", "3.3 V"), ("Temperature range", "-40 to 85 C"), ("Interface", "I2C"), ("Sensor IC", "BME{k}")])], pins=["VCC", "GND", "SDA"], ids=[("SKU", "SKU-{k}"), ("Manufacturer", "{brand}")], resources=[("Datasheet", URL + "bme{k}.pdf")]),
    dict(title="OLED Display {k}", summary="A small screen.", description=("Introduction", "The panel shows text and graphics."), features=["High contrast"], specs=[("Specifications", [("Operating voltage", "3.3 V"), ("Resolution", "128 x 64"), ("Bus", "SPI"), ("Main IC", "SSD{k}")]), ("Technical Specifications", [("Operating voltage", "5 V")])], pins=["VCC", "CLK"], ids=[("Model", "SSD{k}"), ("SKU", "DISPLAY-KIT"), ("Manufacturer", "{brand}")], resources=[("Datasheet", URL + "ssd{k}.pdf"), ("Library", "https://git.example.com/lib")]),
    dict(title="LoRa Radio Module {k}", summary="Long range wireless link.", applications=["Farms", "Meters"], specs=[("Parameters", [("Frequency", "868 MHz"), ("Interface", "SPI"), ("Package", "QFN-24"), ("Pin count", "3")])], pins=["VCC", "MISO"], ids=[("Part number", "SX{k}"), ("Manufacturer", "{brand}")], resources=[("Datasheet", "https://radio.example.org/sx.pdf")]),
    dict(title="Servo Motor Driver {k}", summary="Drives two motors from a control board.", features=["Two channels"], specs=[("Specifications", [("Max current", "2 A"), ("Package", "SOIC")])], ids=[("Part number", "DRV{k}")], usage=("Play with Arduino", "Upload the example and watch the shaft.")),
    dict(title="XIAO Development Board {k}", summary="A board with USB.", description=("What is it", "A tiny board for learning."), features=["USB"], applications=["Wearables"], usage=("Usage", "Press reset twice."), specs=[("Specifications", [("Processor", "dual core"), ("Supply voltage", "5 V"), ("MCU", "ESP{k}"), ("Protocol", "USB")])], pins=["5V", "GND", "D0"], ids=[("Product ID", "PID-{k}"), ("Manufacturer", "{brand}")], resources=[("Schematic", "https://files.example.com/sch/{k}.pdf")]),
    dict(title="Terminal Connector {k}", specs=[("Specification", [("Connector type", "screw"), ("Pin count", "2")])], pins=["A", "B"], ids=[("Part number", "JST{k}"), ("Manufacturer", "{brand}")]),
    dict(title="MOSFET Transistor {k}", summary="An N channel MOSFET.", description=("About", "It switches loads."), specs=[("Specifications", [("Package", "SOT-23"), ("Pins", "3"), ("Max current", "5 A")])], ids=[("Part no", "IRF{k}"), ("Manufacturer", "{brand}")], resources=[("Datasheet", URL + "irf{k}.pdf")]),
    dict(title="ATM{k}", summary="An 8 bit part.", description=("Description", "It runs small programs."), specs=[("Specifications", [("Operating voltage", "5 V"), ("Chip", "ATM{k}"), ("Bus", "UART")])], ids=[("Part number", "ATM{k}"), ("Manufacturer", "{brand}")], resources=[("Datasheet", URL + "atm{k}.pdf")]),
    dict(title="Blue Thing {k}", features=["The description is elsewhere"], specs=[], revision=False),
    dict(title="Push Button {k}", alt="Tactile Switch {k}", summary="A button for breadboards.", features=["Long life, contains SW{k}"], specs=[("Specifications", [("Color", "red")])], pins=["1A", "1B"], ids=[("Model", "SW{k}"), ("Manufacturer", "{brand}")]),
    dict(title="Battery Charger {k}", description=("Product Description", "It charges one cell."), specs=[("Specifications", [("Input voltage", "5 V"), ("Warranty", "2 years"), ("Box", "yes")])], ids=[("Model number", "TP{k}")], revision=False),
    dict(title="Gas Sensor {k}", summary="It uses MQ{k} and has four pins.", features=["Wide range", "Overview of gases"], specs=[("Specifications", [("Operating voltage", "5 V"), ("Interface", "smoke signals")])], ids=[("SKU", "GS-{k}")]),
]
CODES = ["BME", "SSD", "SX", "DRV", "ESP", "JST", "IRF", "ATM", "X", "SW", "TP", "MQ"]
N = len(SHAPES)


def page_text(s: dict) -> str:
    """A recipe as Markdown."""
    out = [f"# {s['title']}", f"![photo](/img/{{k}}.png)", *([s["summary"]] if "summary" in s else []), "```", "Manufacturer: not a fact", "```"]
    out += [f"# {s['alt']}"] if "alt" in s else []
    for heading, kind in (("Product Information", "ids"), ("Features", "features"), ("Use cases", "applications")):
        if s.get(kind):
            out += [f"## {heading}", *(f"{x[0]}: {x[1]}" if kind == "ids" else f"- {x}" for x in s[kind])]
    for kind in ("description", "usage"):
        if kind in s:
            out += [f"## {s[kind][0]}", s[kind][1]]
    for heading, rows in s["specs"]:
        out += [f"## {heading}", "| Parameter | Value |", "| --- | --- |", *(f"| {a} | {b} |" for a, b in rows)]
    if s.get("pins"):
        out += ["## Pin Map", "| Pin | Name | Function |", "| --- | --- | --- |", *(f"| {i} | {p} | signal |" for i, p in enumerate(s["pins"], 1))]
    if s.get("resources"):
        out += ["## Resources", *(f"- [{a}]({b})" for a, b in s["resources"])]
    return "\n".join(out)


def recipe_rows(s: dict) -> list[tuple[int, str, str, str, str, str, int]]:
    """(line, role, a, b, raw, heading, section) of what a page says, from its recipe: ``page_text`` written once more with what each line is."""
    known = dict(markup.IDENTIFIER_LABELS) | {label: "manufacturer" for label in MANUFACTURER_LABELS}
    out, place = [], {"line": 0, "heading": None, "section": 0}

    def add(role: str | None = None, a: str = "", b: str = "", raw: str | None = None, n: int = 1) -> None:
        place["line"] += n
        if role:
            out.append((place["line"], role, a, b, a if raw is None else raw, place["heading"], place["section"]))

    def head(text: str, n: int = 1) -> None:
        place["heading"], place["section"] = text, place["section"] + 1
        add(n=n)

    for n, title in enumerate([s["title"], *([s["alt"]] if "alt" in s else [])]):
        place["heading"], place["section"] = title, place["section"] + 1
        add("title", title)
        if n == 0:
            add("image", "photo", "/img/{k}.png", "![photo](/img/{k}.png)")
            if "summary" in s:
                add("summary", s["summary"])
            add(n=3)
    for heading, kind, role in (("Product Information", "ids", "id"), ("Features", "features", "feature"), ("Use cases", "applications", "application")):
        if s.get(kind):
            head(heading)
            for x in s[kind]:
                add(role, *((known[x[0].lower()], x[1], f"{x[0]}: {x[1]}") if kind == "ids" else (x,)))
    for kind in ("description", "usage"):
        if kind in s:
            head(s[kind][0])
            add("body", s[kind][1], kind)
    for heading, rows in s["specs"]:
        head(heading, 3)
        for a, b in rows:
            add("spec", a, b, f"{a} | {b}")
    if s.get("pins"):
        head("Pin Map", 3)
        for i, p in enumerate(s["pins"], 1):
            add("pin", str(i), p, f"{i} | {p} | signal")
    if s.get("resources"):
        head("Resources")
        for a, b in s["resources"]:
            add("resource", a, b, f"{a} {b}")
    return out


def evidence_lines(s: dict) -> list[str]:
    """The lines of a page that facts come from, as they stand in it."""
    out = [s["title"], *([s["alt"]] if "alt" in s else []), *([s["summary"]] if "summary" in s else []), *(f"{a}: {b}" for a, b in s.get("ids", [])), *s.get("features", []), *s.get("applications", [])]
    out += [s[kind][1] for kind in ("description", "usage") if kind in s] + [f"{a} | {b}" for _, rows in s["specs"] for a, b in rows]
    return out + [f"{i} | {p} | signal" for i, p in enumerate(s.get("pins", []), 1)] + [f"{a} {b}" for a, b in s.get("resources", [])]


def pages(spark, sf_dir) -> DataFrame:
    """p_partkey, brand, shape, revision, text of a page per part."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_partkey") % N).cast("int").alias("shape"))
    text = F.element_at(F.array(*[F.lit(page_text(s)) for s in SHAPES]), F.col("shape") + 1)
    for field, column in (("{k}", F.col("p_partkey").cast("string")), ("{brand}", F.col("brand"))):
        text = F.replace(text, F.lit(field), column)
    revision = F.when(F.element_at(F.array(*[F.lit(s.get("revision", True)) for s in SHAPES]), F.col("shape") + 1), F.lit("r1"))
    return part.select("p_partkey", "brand", "shape", revision.alias("revision"), text.alias("text"))


def page_rows(spark, sf_dir) -> DataFrame:
    """Sections and lines of the pages."""
    rows = markup.sections(markup.lines(pages(spark, sf_dir), "p_partkey", F.col("text")), "p_partkey")
    return rows.withColumn("kind", markup.section_kind(F.col("heading")))


# Labels that name a manufacturer, an interface, a primary part or a package, and how a text names its part.
MANUFACTURER_LABELS = ["manufacturer", "manufacturer name"]
INTERFACE_LABELS = ["bus", "communication interface", "interface", "interfaces", "protocol"]
PRIMARY_IC_LABELS = ["chip", "controller", "main chip", "main ic", "mcu", "microcontroller", "primary ic", "sensor ic"]
PACKAGE_LABELS = ["package", "footprint", "packagecase"]
PART_MENTION = r"\b(?:based on|built around|powered by|uses?)\s+(?:an?\s+)?([A-Z][A-Z0-9._-]{2,31})\b"


def fragments(spark, sf_dir, whole: bool = False) -> DataFrame:
    """One row per page with ``x``: its lines that say something, (line, section, f), f: (role, a, b, raw); as a ``whole``, with pictures and headings."""
    rows = markup.with_cells(page_rows(spark, sf_dir), "p_partkey")
    body, kind, cells = F.trim("body"), F.col("kind"), F.col("cells")
    item = F.nullif(F.trim(F.regexp_extract("body", markup.ITEM, 1)), F.lit(""))
    pair = [F.trim(F.regexp_extract("body", markup.PAIR, i)) for i in (1, 2)]
    link = [F.regexp_extract("body", markup.LINK, i) for i in (1, 2)]
    label = spaced_key(pair[0])
    identifier = F.coalesce(*[F.when(label == name, F.lit(k)) for name, k in markup.IDENTIFIER_LABELS], F.when(label.isin(MANUFACTURER_LABELS), F.lit("manufacturer")))
    plain = (body != "") & ~F.col("is_heading") & ~body.rlike(r"^(!\[|\|)")

    def role(name: str, a: Column, b: Column | None = None, raw: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("role"), a.alias("a"), (F.lit("") if b is None else b).alias("b"), (a if raw is None else raw).alias("raw"))

    found = (
        F.when(body.rlike("^# "), role("title", F.trim(F.substr(body, F.lit(3)))))
        .when(F.col("is_heading"), None)
        .when((kind == "pinout") & (F.size(cells) == 3), role("pin", cells[0], cells[1], F.array_join(cells, " | ")))
        .when((kind == "specifications") & (F.size(cells) == 2), role("spec", cells[0], cells[1], F.array_join(cells, " | ")))
        .when((kind == "resources") & (link[1] != ""), role("resource", link[0], link[1], F.concat_ws(" ", *link)))
        .when((kind == "features") & item.isNotNull(), role("feature", item))
        .when((kind == "applications") & item.isNotNull(), role("application", item))
        .when((kind == "identity") & identifier.isNotNull(), role("id", identifier, pair[1], body))
        .when(plain & kind.isin("description", "usage"), role("body", body, kind))
        .when(plain & (F.col("section") == 1), role("summary", body))
    )
    if whole:
        picture = [F.regexp_extract("body", r"!\[([^\]]*)\]\(([^)\s]+)", i) for i in (1, 2)]
        found = F.coalesce(found, F.when(picture[1] != "", role("image", *picture, body)))
    lines = rows.select("p_partkey", F.struct("line", "section", found.alias("f"), *(["heading"] if whole else [])).alias("x")).where(F.col("x.f").isNotNull())
    return lines.groupBy("p_partkey").agg(F.sort_array(F.collect_list("x")).alias("x"))


def facts(spark, sf_dir) -> DataFrame:
    """One row per page: titles, summaries, details, specs, pins, ids and all evidence lines, in the order of the page."""
    page = fragments(spark, sf_dir)

    def of(*roles: str, field: str = "a") -> Column:
        return F.transform(F.filter("x", lambda x: x["f"]["role"].isin(*roles)), lambda x: x["f"][field])

    # The order of a page is kept; details are bodies and list items, whichever comes first.
    specs = F.transform(F.filter("x", lambda x: x["f"]["role"] == "spec"), lambda x: F.struct(x["section"].alias("section"), x["f"]["a"].alias("label"), x["f"]["b"].alias("value")))
    ids = F.transform(F.filter("x", lambda x: x["f"]["role"] == "id"), lambda x: F.struct(x["f"]["a"].alias("kind"), x["f"]["b"].alias("value")))
    bodies = lambda k: F.filter("x", lambda x: (x["f"]["role"] == "body") & (x["f"]["b"] == k))
    out = page.select(
        "p_partkey", of("title").alias("titles"), of("summary").alias("summaries"), of("body", "feature", "application").alias("details"), of("feature").alias("features"), of("application").alias("applications"),
        F.size(bodies("description")).alias("n_descriptions"), F.size(bodies("usage")).alias("n_usages"), specs.alias("specs"), F.size(of("pin")).alias("n_pins"), ids.alias("ids"),
        F.transform(F.filter("x", lambda x: x["f"]["role"] == "resource"), lambda x: F.struct(x["f"]["a"].alias("label"), x["f"]["b"].alias("target"))).alias("resources"), F.transform("x", lambda x: x["f"]["raw"]).alias("lines"),
    )
    of_kind = lambda *kinds: F.transform(F.filter("ids", lambda i: i["kind"].isin(*kinds)), lambda i: i["value"])
    labelled = F.transform(F.filter("specs", lambda s: spaced_key(s["label"]).isin(PRIMARY_IC_LABELS)), lambda s: s["value"])
    mentioned = F.flatten(F.transform(F.concat("summaries", "details"), lambda t: F.regexp_extract_all(t, F.lit(PART_MENTION), F.lit(1))))
    return out.withColumns({"manufacturer": F.get(of_kind("manufacturer"), F.lit(0)), "part_numbers": of_kind("part_number"), "models": of_kind("model"), "product_ids": of_kind("sku", "model", "product_id"), "ics": F.array_distinct(F.concat(labelled, mentioned))})


def sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def sql_list(xs: list[str]) -> str:
    return "CAST([" + ", ".join(map(sql_text, xs)) + "] AS VARCHAR[])"


def _mentions(s: dict) -> list[str]:
    import re

    texts = [s.get("summary", ""), *(s[k][1] for k in ("description", "usage") if k in s), *s.get("features", []), *s.get("applications", [])]
    return [m for t in texts for m in re.findall(PART_MENTION.replace("[A-Z0-9._-]{2,31}", "[A-Z0-9._{}k-]{2,31}"), t.replace("{k}", "000"))]


def _ics(s: dict) -> list[str]:
    labelled = [b for _, rows in s["specs"] for a, b in rows if a.lower() in PRIMARY_IC_LABELS]
    return list(dict.fromkeys(labelled + [m.replace("000", "{k}") for m in _mentions(s)]))


def _ids(s: dict, *kinds: str) -> list[str]:
    known = dict(markup.IDENTIFIER_LABELS)
    return [b for a, b in s.get("ids", []) if known.get(a.lower()) in kinds]


_rows = [
    "(" + ", ".join((
        str(i), sql_text(s["title"]), sql_list([s["title"], *([s["alt"]] if "alt" in s else [])]), sql_list([s["summary"]] if "summary" in s else []),
        sql_list([s[k][1] for k in ("description", "usage") if k in s] + s.get("features", []) + s.get("applications", [])), sql_list(s.get("features", [])), sql_list(s.get("applications", [])),
        str(int("description" in s)), str(int("usage" in s)), str(len(s.get("pins", []))), str(len(s.get("resources", []))), sql_list(evidence_lines(s)),
        str(any(a == "Manufacturer" for a, _ in s.get("ids", []))).lower(), sql_list(_ids(s, "part_number")), sql_list(_ids(s, "model")), sql_list(_ids(s, "sku", "model", "product_id")), sql_list(_ics(s)), str(s.get("revision", True)).lower(),
        sql_list([b for a, b in s.get("resources", []) if a == "Datasheet"]), sql_text(CODES[i]),
    )) + ")"
    for i, s in enumerate(SHAPES)
]
#: The recipes as rows of one table, for the SQL.
SHAPE_ROWS = "sh(shape, title, titles, summaries, details, features, applications, n_descriptions, n_usages, n_pins, n_resources, lines, has_manufacturer, part_numbers, models, product_ids, ics, has_revision, datasheets, code) AS (VALUES " + ", ".join(_rows) + ")"
#: Their specifications: shape, section, place, label, value.
SPEC_ROWS = "sp(shape, section, nth, label, value) AS (VALUES " + ", ".join(f"({i}, {n}, {m}, {sql_text(a)}, {sql_text(b)})" for i, s in enumerate(SHAPES) for n, (_, rows) in enumerate(s["specs"]) for m, (a, b) in enumerate(rows)) + ")"
#: What their pages say, line by line, and the pages as text.
LINE_ROWS = "fr(shape, line, role, a, b, raw, heading, section) AS (VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else sql_text(x) for x in (i, *row)) + ")" for i, s in enumerate(SHAPES) for row in recipe_rows(s)) + ")"
TEXT_ROWS = "tx(shape, page) AS (VALUES " + ", ".join(f"({i}, {sql_text(page_text(s))})" for i, s in enumerate(SHAPES)) + ")"
