"""Matching of component pages against a symbol index: look-ups, signed contributions, relation, decision.

The index is an inverted table (basis, key, record); a page looks all its keys up
in one equi-join, the best basis of a hit counts, and contributions add to a
confidence of 0 to 1000 with a typed relation and decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions.text import compact_key, datasheet_tokens, identifier_tokens, interfaces, package_tokens, spaced_key

# Weights of the contributions (per mille), severe ones, and thresholds.
WEIGHTS = {
    "exact": 700, "alias": 520, "name": 100, "description": 40, "mention": 150, "canonical": 100, "manufacturer_match": 50, "manufacturer_conflict": -500,
    "datasheet_exact": 80, "datasheet_identity": 60, "datasheet_domain": 30, "datasheet_conflict": -120, "interface_match": 40, "interface_conflict": -180,
    "package_match": 50, "package_conflict": -250, "pins_match": 50, "pins_conflict": -250, "generic": -1000, "unproven": -1000,
}
SEVERE = ["manufacturer_conflict", "package_conflict", "pins_conflict"]
BASES = ["exact", "alias", "name", "description"]
ACCEPT, REJECT, LIMIT = 950, 450, 100
#: Rows of one key that meet in one place, and pages that hit a record before it comes by broadcast.
SPREAD, HOT = 50_000, 10_000
ONBOARD = r"\b(?:based on|built around|contains|equipped with|main ic|onboard|on-board|uses)\b"
# Names of symbols that stand for a class of parts.
GENERIC = ["c", "capacitor", "connector", "crystal", "jumper", "l", "led", "r", "resistor"]


def exact_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_generic(symbol: Column) -> Column:
    name = spaced_key(symbol)
    return F.split(name, " ")[0].isin(GENERIC) | name.startswith("connector generic") | name.rlike(r"^conn(ector)? [0-9]+x[0-9]+$")


def inverted(records: DataFrame, record: str, keys: list[tuple[str, Column]]) -> DataFrame:
    """(basis, key, record): one row per distinct key; each column is an array of keys."""
    every = F.concat(*[F.transform(F.filter(values, lambda v: v != ""), _tag(basis)) for basis, values in keys])
    return records.select(F.col(record).alias("record"), F.explode(F.array_distinct(every)).alias("k")).select("record", "k.basis", "k.key")


def _tag(basis: str):
    return lambda v: F.struct(F.lit(basis).alias("basis"), v.alias("key"))


def _of(basis: str):
    return lambda r: F.struct(r.alias("record"), F.lit(basis).alias("basis"))


def _nth(by: str | list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order))


def spread(many: DataFrame, lists: DataFrame, keys: list[str], query: str, how: str = "inner", size: int | None = None) -> DataFrame:
    """Join on ``keys``; ``lists`` has one row a key. A key that more than ``SPREAD`` rows of ``many`` have is dealt over blocks.

    With a ``size`` blocks have so many rows, and stay in as many partitions as a shuffle has: for rows that are short but make long work.
    """
    most = size or SPREAD
    hot = F.broadcast(many.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("block", F.pmod(F.xxhash64(query), blocks).cast("int")).drop("blocks")
    if size:
        dealt = dealt.repartition(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "block")
    return dealt.join(lists.join(hot, keys, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks"), [*keys, "block"], how).drop("block")


def by_description(asked: DataFrame, query: str, index: DataFrame, limit: int) -> DataFrame:
    """(query, records): the ``limit`` records that share most tokens with the query, ties to the smaller record.

    Queries that ask with the same tokens of the index are one, and so are records with the same tokens: only distinct
    sets meet. A set of records stands for its ``limit`` smallest, as no other of them can be among the best, and so do
    the ``limit`` sets that share most, ties to the smaller first record: each of them gives a record ahead of all other sets'.
    """
    tokens = lambda side, key, name: side.groupBy(key).agg(F.sort_array(F.collect_set("key")).alias(name))
    known = index.select("key").distinct()
    ours, theirs = tokens(asked.join(known, "key", "left_semi"), query, "ours"), tokens(index, "record", "theirs")
    each = lambda sets, name: sets.select(name).distinct().select(name, F.explode(name).alias("key"))
    shared = each(ours, "ours").join(each(theirs, "theirs"), "key").groupBy("ours", "theirs").agg(F.count("*").alias("shared"))
    bearers = theirs.withColumn("nth", _nth("theirs", "record")).where(F.col("nth") <= limit).groupBy("theirs").agg(F.sort_array(F.collect_list("record")).alias("records"))
    met = shared.join(bearers, "theirs").withColumn("first", F.get("records", F.lit(0))).withColumn("nth", _nth("ours", F.desc("shared"), "first")).where(F.col("nth") <= limit)
    sets = met.groupBy("ours").agg(F.collect_list(F.struct((-F.col("shared")).alias("s"), "records")).alias("x"))
    inner = F.flatten(F.transform("x", lambda x: F.transform(x["records"], lambda r: F.struct(x["s"].alias("s"), r.alias("record")))))
    best = sets.select("ours", F.transform(F.slice(F.sort_array(inner), 1, limit), lambda x: x["record"]).alias("records"))
    return spread(ours, best, ["ours"], query).select(query, "records")


def listed(queries: DataFrame, query: str, index: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query, hits): the ``limit`` first hits (record, basis) of every query by best basis, then record, in one list.

    ``queries``: (record, basis, key) of those who ask. Of a key that many records bear, only the ``limit`` smallest can come
    among the first ``limit`` of any query, so a key gives no more; hits by description are the ``limit`` nearest.
    """
    asked = queries.withColumnRenamed("record", query)
    short = index.where("basis <> 'description'").withColumn("nth", _nth(["basis", "key"], "record")).where(F.col("nth") <= limit).groupBy("basis", "key").agg(F.collect_list("record").alias("records"))
    keyed = spread(asked.where("basis <> 'description'"), short, ["basis", "key"], query).select(query, "basis", "records")
    described = by_description(asked.where("basis = 'description'").select(query, "key"), query, index.where("basis = 'description'").select("key", "record"), limit)
    found = keyed.unionByName(described.withColumn("basis", F.lit("description")))
    found = found.groupBy(query).agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("basis") == b, F.col("records")))))).alias(b) for b in BASES])
    for n, b in enumerate(BASES[1:], 1):  # the best basis of a record counts
        found = found.withColumn(b, F.array_except(b, F.concat(*BASES[:n])))
    every = F.concat(*[F.transform(b, _of(b)) for b in BASES])
    return found.select(query, F.slice(every, 1, limit).alias("hits"))


def lookups(queries: DataFrame, query: str, index: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query, record, basis): the lists of ``listed``, a row for each hit."""
    return listed(queries, query, index, limit).select(query, F.explode("hits").alias("h")).select(query, "h.record", "h.basis")


def paired(lists: DataFrame, pages: DataFrame, records: DataFrame, query: str) -> DataFrame:
    """The hits of ``lists`` (query, hits: an array of structs with a ``record``) with the columns of their page and of their record.

    Lists meet their pages first, as neither side has more than one row a query. Records that more than ``HOT`` pages hit,
    at most ``LIMIT`` a ``HOT`` pages, come by broadcast; hits of all others are shuffled by record and by query.
    """
    hits = lists.select(query, F.explode("hits").alias("h")).select(query, "h.*")
    hot = F.broadcast(hits.groupBy("record").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("record"))
    often = lists.join(pages, query).select("*", F.explode("hits").alias("h")).select("*", "h.*").drop("h", "hits").join(F.broadcast(records.join(hot, "record", "left_semi")), "record")
    seldom = hits.join(hot, "record", "left_anti").join(records, "record").join(pages, query)
    return often.unionByName(seldom)


def contribution(condition: Column, rule: str) -> Column:
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(WEIGHTS[rule]).alias("weight")))


def either(applies: Column, good: Column, yes: str, no: str) -> Column:
    """One of two opposite contributions, where both sides say something."""
    return F.when(applies, F.coalesce(contribution(good, yes), contribution(F.lit(True), no)))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1))


def _place(url: Column) -> Column:
    return F.concat(_host(url), F.rtrim(F.lower(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)), F.lit("/")))


def page_side(pages: DataFrame) -> DataFrame:
    """What matching needs of a page, made once for all its hits.

    Of titles, part_numbers, ics, kind, manufacturer, interfaces, datasheets, package, pin_count, lines.
    """
    compact = lambda values: F.transform(values, compact_key)
    lines = F.transform("lines", lambda x: F.struct(identifier_tokens(x).alias("tokens"), F.lower(x).rlike(ONBOARD).alias("onboard")))
    cols = {
        "kind": F.col("kind"), "interfaces": F.col("interfaces"), "pin_count": F.col("pin_count"), "p_numbers": compact("part_numbers"), "p_ics": compact("ics"), "p_title": compact_key(F.col("titles")[0]),
        "p_maker": compact_key(F.col("manufacturer")), "p_package": package_tokens(F.col("package")), "p_lines": lines,
        "p_places": F.transform("datasheets", _place), "p_hosts": F.transform("datasheets", _host), "p_sheets": F.flatten(F.transform("datasheets", datasheet_tokens)),
    }
    out = pages.withColumns({name: c for name, c in cols.items() if name.startswith("p_")})
    return out.withColumn("p_tokens", F.array_distinct(F.flatten(F.transform("p_lines", lambda x: x["tokens"])))).select(*[c for c in pages.columns if c not in cols], *cols, "p_tokens")


def record_side(records: DataFrame) -> DataFrame:
    """What matching needs of a record: of symbol, r_aliases, makers, datasheet, words, filters, pins, library."""
    c = F.col
    keys = F.filter(F.transform(F.concat(F.array("symbol"), "r_aliases"), compact_key), lambda k: k != "")
    return records.select(
        "record", "pins", F.array_distinct(keys).alias("keys"), interfaces(c("words")).alias("faces"), is_generic(c("symbol")).alias("generic"),
        F.concat_ws(" ", spaced_key(c("library")), spaced_key(c("symbol"))).rlike(r"(^| )connector( |$)").alias("plug"), F.transform("makers", compact_key).alias("r_makers"),
        F.when(F.size("filters") > 0, package_tokens(F.array_join("filters", " "))).alias("r_filters"), _place(c("datasheet")).alias("r_place"), _host(c("datasheet")).alias("r_host"), datasheet_tokens(c("datasheet")).alias("r_sheets"),
    )


def datasheet() -> Column:
    """The strongest that two references to data sheets say about each other."""
    c = F.col
    return F.when(
        c("r_place").isNotNull() & (F.size("p_places") > 0),
        F.coalesce(
            contribution(F.array_contains("p_places", c("r_place")), "datasheet_exact"), contribution(F.arrays_overlap("r_sheets", "p_sheets"), "datasheet_identity"),
            contribution(F.array_contains("p_hosts", c("r_host")), "datasheet_domain"), contribution((F.size("r_sheets") > 0) & (F.size("p_sheets") > 0), "datasheet_conflict"),
        ),
    )


def matched(hits: DataFrame) -> DataFrame:
    """Hits with the columns of ``page_side`` and ``record_side``, and ``same_maker``, ``relation``, ``given``, ``score``, ``decision``."""
    c = F.col
    mentions = F.filter("p_lines", lambda x: F.arrays_overlap("keys", x["tokens"]))
    out = hits.withColumn("mentions", F.when(F.arrays_overlap("keys", "p_tokens"), F.transform(mentions, lambda x: x["onboard"])).otherwise(F.array().cast("array<boolean>")))
    out = out.withColumns({"named": F.size("mentions") > 0, "canonical": F.array_contains("keys", c("p_title")), "same_maker": F.array_contains("r_makers", c("p_maker"))})
    named, canonical, plug = c("named"), c("canonical"), c("plug")
    numbered, primary = F.arrays_overlap("keys", "p_numbers"), F.arrays_overlap("keys", "p_ics")
    relation = (
        F.when((c("kind") == "connector") & plug, "connector").when(numbered, "exact_component")
        .when(primary & c("kind").isin("module", "development_board"), "main_integrated_circuit").when(primary, "exact_component")
        .when(canonical & c("kind").isin("discrete_component", "integrated_circuit"), "exact_component").when(plug & named, "connector")
        .when(F.array_contains("mentions", True), "onboard_component").otherwise("functional_equivalent")
    )
    hit = [*[contribution(c("basis") == b, b) for b in BASES], contribution(named, "mention"), contribution(canonical, "canonical")]
    facts = [
        either(c("p_maker").isNotNull() & (F.size("r_makers") > 0), c("same_maker"), "manufacturer_match", "manufacturer_conflict"), datasheet(),
        either((F.size("interfaces") > 0) & (F.size("faces") > 0), F.arrays_overlap("interfaces", "faces"), "interface_match", "interface_conflict"),
        either(c("p_package").isNotNull() & c("r_filters").isNotNull(), F.arrays_overlap("p_package", "r_filters"), "package_match", "package_conflict"),
        either(c("pin_count").isNotNull() & (c("pins") > 0), c("pin_count") == c("pins"), "pins_match", "pins_conflict"), contribution(c("generic") & (c("basis") != "exact"), "generic"),
    ]
    said = {f"said{n}": x for n, x in enumerate([*hit, *facts])}
    out = out.withColumns({"relation": relation, **said})
    weights = [F.coalesce(c(name)["weight"], F.lit(0)) for name in said]
    out = out.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(1000), sum(weights[1:], weights[0]))), "given": F.array_compact(F.array(*said))})
    # Fragments of evidence: the lines that mention the symbol, and one for each other agreement.
    agreed = [(w > 0).cast("int") for w in weights[len(hit):]]
    some = lambda tests: F.greatest(*tests)
    severe, opposed = some([F.coalesce(c(name)["rule"].isin(SEVERE), F.lit(False)) for name in said]), some([w < 0 for w in weights])
    sure = (c("relation") == "exact_component") & (c("basis") == "exact") & ~opposed & ~c("generic") & (F.size("mentions") + sum(agreed[1:], agreed[0]) >= 2) & (c("score") >= ACCEPT)
    out = out.withColumn("same_maker", F.coalesce("same_maker", F.lit(False)))
    return out.withColumn("decision", F.when(severe, "rejected").when(sure, "auto_accepted").when(c("score") < REJECT, "rejected").otherwise("review")).drop(*said)
