"""Symbol libraries: parsed records, inherited fields, listings of the older form.

Libraries are composed from parts, fifty symbols each, in S-expressions; a symbol's
shape is its part's key modulo ten: a base with all fields and nested units, three
that extend one another, two that extend each other, one whose parent is missing,
one with odd pins, one generic, one without a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import spaced_key
from partwise.operators import matching as m
from partwise.operators.inheritance import inherited
from partwise.plans.registry import query, table
from partwise.sources import sexpr

# Prefixes of libraries that are read, and categories by prefix.
LIBRARIES = ["Sensor_", "MCU_", "Display_", "74xx", "Relay", "Switch", "Connector", "Motor", "Driver_Motor", "Regulator_", "Transistor_", "Transistor_Array", "Timer", "Diode", "LED", "Memory", "Interface_"]
CATEGORIES = [
    (["Sensor_"], "sensors"), (["Display_", "LED"], "displays"), (["Relay", "Motor", "Driver_Motor"], "actuators"), (["Switch"], "input"), (["Regulator_"], "power"), (["Interface_"], "communication"),
    (["Connector"], "prototyping"), (["MCU_", "74xx", "Timer", "Memory"], "integrated-circuits"), (["Transistor_", "Transistor_Array", "Diode"], "semiconductors"),
]
# Electrical types of pins.
ELECTRICAL = ["input", "output", "bidirectional", "tri_state", "passive", "free", "unspecified", "power_in", "power_out", "open_collector", "open_emitter", "no_connect"]

#: Names of the composed libraries, by number modulo eight; the last has another root, ``Misc`` isn't read.
NAMES = ["Sensor_Air", "MCU_Small", "Misc", "Connector_Round", "Regulator_Linear", "LED", "Timer", "Memory_Flash"]
ROOT = "symbol_library"


def libraries(spark, sf_dir) -> DataFrame:
    """(path, content) of a library per fifty parts."""
    k, i = F.col("p_partkey"), F.col("p_partkey") % 10
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    prop = lambda key, value: say(f'(property "{key}" "', value, '") ')
    pin = lambda kind, number, name: f'(pin {kind} line (name "{name}") (number "{number}"))'
    base = F.concat(
        prop("Value", say("S", k)), prop("Reference", F.lit("U")), prop("Description", F.col("p_name")), prop("Datasheet", say("https://files.example.com/s", k, ".pdf")), prop("ki_keywords", say("fast, small ", F.col("p_type"))),
        prop("Manufacturer", F.col("p_brand")), prop("ki_aliases", say("ALT-", k, "; ALTB-", k, ";;")), prop("Footprint", F.lit("SOT-23")), F.lit('(footprint_filters "SOT*" "SOIC*" "SOT*") '), F.lit(pin("input", "1", "IN") + pin("power_in", "2", "VCC")),
        say('(symbol "S', k, '_1_1" ', pin("output", "3", "OUT"), ') (symbol "S', k, '_2_1" ', pin("passive", "4", "A"), ')'),
    )
    body = (
        F.when(i == 0, base).when(i == 1, say('(extends "S', k - 1, '") ', prop("Value", say("V", k))))
        .when(i == 2, say('(extends "S', k - 1, '") ', prop("Description", say("variant ", k)), prop("Datasheet", F.lit("~"))))
        .when(i == 3, say('(extends "S', k - 1, '") (footprint_filters "QFN*")', prop("Manufacturer_Name", F.lit("Other Corp"))))
        .when(i == 4, say('(extends "S', k + 1, '") ', prop("Description", say("loop ", k)))).when(i == 5, say('(extends "S', k - 1, '")'))
        .when(i == 6, say('(extends "X', k, '") ', prop("Value", say("S", k)))).when(i == 7, F.lit(pin("strange", "1", "A") + pin("input", "2", "B") + '(pin output line (name "C"))(pin)'))
        .otherwise(prop("Description", F.col("p_name")))
    )
    name = F.when(i == 9, F.lit("")).when(i == 8, say('"Conn_01x', k, '" ')).otherwise(say('"S', k, '" '))
    lib = F.floor(k / 50)
    rows = table(spark, sf_dir, "part").select(lib.alias("lib"), F.struct(k, say("(symbol ", name, body, ")").alias("s")).alias("x"))
    number = F.col("lib") % len(NAMES)
    root = F.when(number == 7, "other_root").otherwise(ROOT)
    path = say("lib/", F.element_at(F.array(*[F.lit(n) for n in NAMES]), (number + 1).cast("int")), "/", F.col("lib"), ".sym")
    whole = rows.groupBy("lib").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # fifty symbols
    return whole.select(path.alias("path"), say("(", root, " (version 2024) ", F.array_join(F.transform("xs", lambda x: x["s"]), " "), ")").cast("binary").alias("content"))


def library_of(path: Column) -> Column:
    """The folder that a library lies in."""
    return F.element_at(F.split(path, "/"), -2)


def has_prefix(library: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: library.startswith(p))


def split_values(c: Column, pattern: str) -> Column:
    """Distinct non-empty values of a list in a text."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda v: F.trim(v)), lambda v: v != ""))


def pin_texts(pins: Column) -> Column:
    return F.array_join(F.transform(pins, lambda p: F.concat_ws("/", F.coalesce(p["number"], F.lit("")), F.coalesce(p["name"], F.lit("")), p["electrical"], p["unit"])), ",")


def odd_types(pins: Column) -> Column:
    """A warning for each electrical type that isn't known."""
    return F.transform(F.filter(pins, lambda p: ~p["electrical"].isin(ELECTRICAL)), lambda p: F.concat(F.lit("unknown_electrical_type:"), F.substring(p["electrical"], 1, 80)))


def parsed(rows: DataFrame) -> DataFrame:
    """Index records of parsed symbols with their own fields; null or empty ones are inherited later."""
    props, filled = F.col("props"), lambda c: F.nullif(c, F.lit(""))
    aliases = F.concat(
        F.filter(F.array(props["Value"]), lambda v: (v != "") & (v != F.col("symbol"))), split_values(props["Aliases"], "[,;|]+"), split_values(props["ki_aliases"], "[,;|]+"), F.array_compact(F.array("extends")),
    )
    makers = F.array_distinct(F.filter(F.array(*[props[k] for k in ("Manufacturer", "Manufacturer_Name", "ki_manufacturer")]), lambda v: F.trim(v) != ""))
    whole = F.filter("pins", lambda p: (F.coalesce(p["number"], F.lit("")) != "") & (F.coalesce(p["name"], F.lit("")) != ""))
    notes = F.array_distinct(F.concat(odd_types(F.col("pins")), F.when(F.size(whole) < F.size("pins"), F.array(F.lit("pin_identity_missing"))).otherwise(F.array().cast("array<string>"))))
    some = lambda values: F.when(F.size(values) > 0, values)
    return rows.where("error IS NULL AND symbol IS NOT NULL").where(F.col("root") == ROOT).select(
        "path", "symbol", library_of(F.col("path")).alias("library"), "extends", F.array_distinct(F.filter(aliases, lambda v: F.trim(v) != "")).alias("aliases"), notes.alias("warnings"), m.is_generic(F.col("symbol")).alias("is_generic"),
        filled(props["Description"]).alias("description"), F.when(~props["Datasheet"].isin("", "~", "-"), props["Datasheet"]).alias("datasheet"), some(split_values(props["ki_keywords"], r"[\s,;|]+")).alias("keywords"),
        some(makers).alias("makers"), some(F.col("filters")).alias("filters"), some(whole).alias("pins"),
    )


INHERITED = ["description", "datasheet", "keywords", "makers", "filters", "pins"]


def index_records(spark, sf_dir) -> DataFrame:
    """All records of the libraries that are read, with what they inherit."""
    own = parsed(sexpr.records(libraries(spark, sf_dir))).where(has_prefix(F.col("library"), LIBRARIES))
    return inherited(own, ["path", "symbol"], "extends", INHERITED)


# The same by SQL: own fields by shape (o), chains by recursion (ch), fields from the nearest (f).
_list = lambda *xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_key = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_PINS = "'1/IN/input/1,2/VCC/power_in/1,3/OUT/output/1,4/A/passive/2'"
OWN = f"""
p AS (SELECT p_partkey AS k, p_partkey % 10 AS i, p_partkey // 50 AS lib, p_name, p_brand, p_type FROM part),
s AS (SELECT *, {_list(*NAMES)}[1 + lib % 8] AS library, CASE i WHEN 9 THEN NULL WHEN 8 THEN 'Conn_01x' || k ELSE 'S' || k END AS symbol, CASE i WHEN 1 THEN 'S' || (k - 1) WHEN 2 THEN 'S' || (k - 1) WHEN 3 THEN 'S' || (k - 1) WHEN 4 THEN 'S' || (k + 1) WHEN 5 THEN 'S' || (k - 1) WHEN 6 THEN 'X' || k END AS extends,
  CASE i WHEN 0 THEN p_name WHEN 2 THEN 'variant ' || k WHEN 4 THEN 'loop ' || k WHEN 8 THEN p_name END AS description, CASE WHEN i = 0 THEN 'https://files.example.com/s' || k || '.pdf' END AS datasheet FROM p),
o AS (SELECT *, 'lib/' || library || '/' || lib || '.sym' AS path, CASE WHEN i = 0 THEN 'fast|small|' || p_type END AS keywords, CASE i WHEN 0 THEN p_brand WHEN 3 THEN 'Other Corp' END AS makers, CASE i WHEN 0 THEN 'SOT*|SOIC*' WHEN 3 THEN 'QFN*' END AS filters,
  CASE i WHEN 0 THEN {_PINS} WHEN 7 THEN '1/A/strange/1,2/B/input/1' END AS pins, CASE i WHEN 0 THEN 'ALT-' || k || '|ALTB-' || k WHEN 1 THEN 'V' || k || '|' || extends ELSE coalesce(extends, '') END AS aliases FROM s WHERE lib % 8 NOT IN (2, 7) AND i <> 9)"""


@query(f"""
WITH RECURSIVE {OWN},
ch(path, symbol, node, depth, seen, looped) AS (SELECT path, symbol, symbol, 0, [symbol], false FROM o
  UNION ALL SELECT ch.path, ch.symbol, up.symbol, ch.depth + 1, list_append(seen, up.symbol), list_contains(seen, up.symbol) FROM ch JOIN o AS own ON own.path = ch.path AND own.symbol = ch.node JOIN o AS up ON up.path = ch.path AND up.symbol = own.extends WHERE NOT looped),
t AS (SELECT path, symbol, bool_or(looped) AS looped, max(depth) AS depth, max_by(node, depth) AS ancestor FROM ch GROUP BY 1, 2),
f AS (SELECT ch.path, ch.symbol, arg_min(description, ch.depth) FILTER (WHERE description IS NOT NULL) AS description, arg_min(datasheet, ch.depth) FILTER (WHERE datasheet IS NOT NULL) AS datasheet, arg_min(keywords, ch.depth) FILTER (WHERE keywords IS NOT NULL) AS keywords,
  arg_min(makers, ch.depth) FILTER (WHERE makers IS NOT NULL) AS makers, arg_min(filters, ch.depth) FILTER (WHERE filters IS NOT NULL) AS filters, arg_min(pins, ch.depth) FILTER (WHERE pins IS NOT NULL) AS pins FROM ch JOIN t USING (path, symbol) JOIN o ON o.path = ch.path AND o.symbol = ch.node WHERE NOT t.looped OR ch.depth = 0 GROUP BY 1, 2)
SELECT o.path, o.symbol, o.library, o.aliases, f.description, f.datasheet, coalesce(f.keywords, '') AS keywords, coalesce(f.makers, '') AS makers, coalesce(f.filters, '') AS filters, coalesce(f.pins, '') AS pins, o.i = 8 AS is_generic, CASE WHEN o.i = 7 THEN 'unknown_electrical_type:strange|pin_identity_missing' ELSE '' END AS warnings,
  CASE WHEN NOT looped THEN CAST(t.depth AS BIGINT) END AS depth, CASE WHEN NOT looped THEN ancestor END AS ancestor, CASE WHEN looped THEN 'cycle' WHEN EXISTS (SELECT 1 FROM o e WHERE e.path = o.path AND e.symbol = t.ancestor AND e.extends IS NOT NULL) THEN 'missing_parent' WHEN t.depth > 0 THEN 'ok' ELSE 'none' END AS inherits
FROM o JOIN t ON t.path = o.path AND t.symbol = o.symbol JOIN f ON f.path = o.path AND f.symbol = o.symbol""")
def idx_parse(spark, sf_dir):
    """Index records of all symbols: properties, aliases, pins by unit, filters, the generic flag, and what is inherited along ``extends``."""
    one = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return index_records(spark, sf_dir).select(
        "path", "symbol", "library", one("aliases"), "description", "datasheet", one("keywords"), one("makers"), one("filters"), F.coalesce(pin_texts(F.col("pins")), F.lit("")).alias("pins"), "is_generic", one("warnings"), "depth", "ancestor", "inherits"
    )


_prefixed = lambda prefixes: "(" + " OR ".join(f"starts_with(library, '{p}')" for p in prefixes) + ")"


@query(f"""
WITH {OWN.replace("FROM s WHERE lib % 8 NOT IN (2, 7) AND i <> 9)", "FROM s)")},
c AS (SELECT *, CASE WHEN NOT {_prefixed(LIBRARIES)} THEN 'unsupported' WHEN lib % 8 = 7 THEN 'drift' WHEN symbol IS NULL THEN 'invalid' WHEN i = 7 THEN 'parsed_with_warnings' ELSE 'parsed' END AS status FROM o),
d AS (SELECT *, status LIKE 'parsed%' AS good FROM c)
SELECT path, CAST(k - 50 * lib - (SELECT min(q.k) - 50 * (min(q.k) // 50) FROM p q WHERE q.lib = d.lib) AS INTEGER) AS nth, library, symbol, status, CASE status WHEN 'unsupported' THEN 'library_not_allowlisted' WHEN 'drift' THEN 'root_missing' WHEN 'invalid' THEN 'symbol_name_missing' WHEN 'parsed_with_warnings' THEN 'unknown_electrical_type:strange' ELSE '' END AS warnings,
  CASE WHEN good THEN CASE WHEN i = 0 THEN 'U' ELSE '' END END AS reference, CASE WHEN good THEN CASE WHEN i = 1 THEN 'V' || k ELSE symbol END END AS value, CASE WHEN good THEN coalesce(description, '') END AS description, CASE WHEN good THEN CASE WHEN i = 0 THEN 'fast, small ' || p_type ELSE '' END END AS keywords,
  CASE WHEN good THEN CASE WHEN i = 0 THEN 'SOT-23' ELSE '' END END AS footprint, CASE WHEN good THEN coalesce(filters, '') END AS filters, CASE WHEN good THEN CASE WHEN i = 7 THEN pins || ',/C/output/1,//unspecified/1' ELSE coalesce(pins, '') END END AS pins, CASE WHEN good THEN '2024' END AS format_version,
  CASE WHEN good THEN CASE {" ".join(f"WHEN {_prefixed(p)} THEN '{c}'" for p, c in CATEGORIES)} ELSE 'other' END END AS category_hint, CASE WHEN good AND i IN (0, 2) THEN coalesce(datasheet, '~') END AS datasheet_url, CASE WHEN good THEN extends END AS extends FROM d""")
def src_symbol_lib_v1(spark, sf_dir):
    """The older listing: every symbol with its own fields, status and warnings; nothing is inherited here."""
    library = library_of(F.col("path"))
    rows, props = sexpr.records(libraries(spark, sf_dir)), F.col("props")
    allowed, rooted = has_prefix(library, LIBRARIES), F.col("root") == ROOT
    notes = F.array_distinct(odd_types(F.col("pins")))
    status = F.when(~allowed, "unsupported").when(F.col("error").isNotNull(), "invalid").when(~rooted, "drift").when(F.col("symbol").isNull(), "invalid").when(F.size(notes) > 0, "parsed_with_warnings").otherwise("parsed")
    told = F.when(~allowed, "library_not_allowlisted").when(F.col("error").isNotNull(), F.col("error")).when(~rooted, "root_missing").when(F.col("symbol").isNull(), "symbol_name_missing").otherwise(F.array_join(notes, "|"))
    own = lambda c: F.when(F.col("status").startswith("parsed"), c)
    text = lambda key, other="": own(F.coalesce(props[key], F.lit(other) if isinstance(other, str) else other))
    category = F.coalesce(*[F.when(has_prefix(library, prefixes), c) for prefixes, c in CATEGORIES], F.lit("other"))
    return rows.withColumn("status", status).select(
        "path", "nth", library.alias("library"), "symbol", "status", told.alias("warnings"), text("Reference").alias("reference"), text("Value", F.col("symbol")).alias("value"), text("Description").alias("description"), text("ki_keywords").alias("keywords"),
        text("Footprint").alias("footprint"), own(F.array_join("filters", "|")).alias("filters"), own(pin_texts(F.col("pins"))).alias("pins"), own(F.coalesce("version", F.lit("unknown"))).alias("format_version"), own(category).alias("category_hint"),
        own(F.nullif(props["Datasheet"], F.lit(""))).alias("datasheet_url"), own(F.col("extends")).alias("extends"),
    )
