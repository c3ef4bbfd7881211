"""Matching of component pages against an index of symbol records.

Pages and their facts are those of ``components``; every part also gives one
record of the index, of eight forms, so that each rule applies somewhere. Records
compete: those of one form share an alias that many pages ask for, those of
another a word of many titles, and those of the first form have a twin. All pages are
held against all records, a page keeps its hundred first hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import compact_key, index_tokens, spaced_key
from partwise.operators import matching as m
from partwise.operators import tables
from partwise.plans import components, identity, normalize
from partwise.plans.registry import also, query, table

FORMS = 8
#: The twin of a record has its number plus this.
TWIN = 1_000_000_000
#: What the matcher needs of a page.
PAGE = ["titles", "part_numbers", "ics", "kind", "manufacturer", "interfaces", "datasheets", "package", "pin_count", "lines"]


def records(spark, sf_dir) -> DataFrame:
    """One symbol record per part; its form is (key div 12) modulo 8."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), F.col("p_brand").alias("brand"))
    key, shape, form = F.col("record").cast("string"), (F.col("record") % components.N).cast("int"), (F.floor(F.col("record") / components.N) % FORMS).cast("int")
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in components.CODES]), shape + 1), key)
    title = F.replace(F.element_at(F.array(*[F.lit(x["title"]) for x in components.SHAPES]), shape + 1), F.lit("{k}"), key)
    none = F.array().cast("array<string>")
    pick = lambda cases, other: F.coalesce(*[F.when(form.isin(*forms), value) for forms, value in cases], other)
    out = part.select(
        "record", form.alias("form"), pick([((1,), F.concat(F.lit("ALT-"), key)), ((2,), title), ((3,), F.concat(F.lit("D"), key)), ((5,), F.lit("R")), ((6,), F.concat(F.lit("Conn_"), key))], code).alias("symbol"),
        pick([((1, 5, 6), F.array(code)), ((3,), F.array(F.lit("DISPLAY-KIT")))], none).alias("r_aliases"), pick([((0, 7), F.array("brand")), ((4,), F.array(F.lit("Other Corp")))], none).alias("makers"),
        F.coalesce(*[F.when(form == n, u) for n, u in ((0, F.concat(F.lit(components.URL), F.lower(code), F.lit(".pdf"))), (1, F.lit(components.URL + "other1234.pdf")), (2, F.concat(F.lit("https://mirror.example.net/"), F.lower(code), F.lit("-sheet.pdf"))), (7, F.lit("https://other.example.net/zz9999.pdf")))]).alias("datasheet"),
        pick([((0,), F.lit("digital part with I2C")), ((3,), F.concat(F.lit("peripheral "), key)), ((7,), F.lit("CAN transceiver")), ((1,), F.lit("sensor element"))], F.lit("part")).alias("words"),
        pick([((0,), F.array(F.lit("SOT*"), F.lit("SOIC*"))), ((6,), F.array(F.lit("QFN*")))], none).alias("filters"), pick([((0, 4), F.lit(3)), ((6,), F.lit(8))], F.lit(0)).alias("pins"), pick([((6,), F.lit("Connector_Generic"))], F.lit("Parts")).alias("library"),
    )
    return out.unionByName(out.where("form = 0").withColumn("record", F.col("record") + TWIN))


def index(rows: DataFrame) -> DataFrame:
    """The inverted index of symbol records."""
    names = F.concat(F.array("symbol"), "r_aliases")
    every = m.inverted(rows, "record", [("exact", F.array(m.exact_key(F.col("symbol")))), ("alias", F.transform("r_aliases", m.exact_key)), ("name", F.transform(names, compact_key)), ("description", index_tokens(F.col("words")))])
    generic = rows.where(m.is_generic(F.col("symbol"))).select("record")  # found by exact part numbers alone
    return every.where("basis = 'exact'").unionByName(every.where("basis <> 'exact'").join(generic, "record", "left_anti"))


def identities(spark, sf_dir) -> DataFrame:
    """Identities of all pages, made once."""
    return tables.once(spark, sf_dir, "identities", lambda: identity.identities(normalize.facts(spark, sf_dir)))


def sides(rows: DataFrame) -> DataFrame:
    """What the matcher needs of identified pages, and the keys that they ask with."""
    spec = lambda test, cut: F.get(F.filter(F.transform(F.filter("specs", lambda s: test(spaced_key(s["label"]))), lambda s: cut(s["value"])), lambda v: v.isNotNull()), F.lit(0))
    explicit, other = F.concat("part_numbers", "ics"), F.concat("product_ids", "aliases")
    keys = [("exact", F.transform(explicit, m.exact_key)), ("alias", F.transform(F.concat(explicit, other), m.exact_key)), ("name", F.transform(F.concat(F.slice("titles", 1, 1), other), compact_key)), ("description", index_tokens(F.col("titles")[0]))]
    return rows.withColumns({
        "package": spec(lambda label: compact_key(label).isin(components.PACKAGE_LABELS), lambda v: v), "pin_count": spec(lambda label: label.rlike("^(number of )?pins?( count)?$"), lambda v: F.nullif(F.regexp_extract(v, "[0-9]+", 0), F.lit("")).cast("int")),
        "datasheets": F.transform(F.filter("resources", lambda r: F.contains(F.lower(r["label"]), F.lit("datasheet"))), lambda r: r["target"]), "asked": F.array(*[F.struct(F.lit(b).alias("basis"), v.alias("keys")) for b, v in keys]),
    })


def hits(spark, sf_dir, identified: DataFrame | None = None) -> DataFrame:
    """The first hits of all pages in the index of all records, with both sides' columns."""
    pages = sides(identities(spark, sf_dir) if identified is None else identified).select("p_partkey", "asked", *PAGE)
    pages, known = tables.stored(m.page_side(pages.withColumnRenamed("p_partkey", "query")), "match-pages"), records(spark, sf_dir)
    asked = pages.select(F.col("query").alias("record"), F.explode("asked").alias("a")).select("record", "a.basis", F.explode(F.array_distinct("a.keys")).alias("key")).where("key <> ''")
    lists = tables.stored(m.listed(asked, "query", index(known)), "match-lists")
    return m.paired(lists, pages.drop("asked"), tables.stored(m.record_side(known), "match-records"), "query")


def scored(spark, sf_dir, identified: DataFrame | None = None) -> DataFrame:
    """All hits with their relation, contributions, score and decision, made once."""
    columns = ["query", "record", "basis", "same_maker", "relation", "given", "score", "decision"]
    return tables.once(spark, sf_dir, "matches", lambda: m.matched(hits(spark, sf_dir, identified)).select(*columns))


_list = "list_transform({0}, lambda x: {1})"
_compact = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
_tokens = lambda x: f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 2 AND t NOT IN ('a','an','and','for','grove','module','of','the','with'))"
_overlap = lambda a, b: f"len(list_intersect({a}, {b})) > 0"
_fill = lambda c: f"list_transform({c}, lambda x: replace(replace(x, '{{k}}', p_partkey::VARCHAR), '{{brand}}', p_brand))"
_ds = lambda u: f"list_filter(regexp_extract_all(lower(regexp_extract({u}, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '[a-z]*[0-9]+[a-z0-9]*'), lambda t: length(t) >= 4 AND t <> 'ds002')"
_pk = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda t: length(t) >= 2 AND t NOT IN ('filter', 'footprint', 'package'))"
#: Pages (pg), records (k) and the hits of each page in all records (h), by an equi-join of their keys.
HITS = f"""{identity.IDENTITY},
pg AS (SELECT p_partkey, p_brand, x.shape, replace(title, '{{k}}', p_partkey::VARCHAR) AS title, {_fill("part_numbers")} AS pns, {_fill("ics")} AS ics, {_fill("product_ids")} AS pids, {_fill("aliases")} AS aliases, {_fill("lines")} AS lines, {_fill("datasheets")} AS dss,
  kind, CASE WHEN has_manufacturer THEN p_brand END AS maker, code || p_partkey AS code, n_conflicts, status, warnings, ics AS shape_ics,
  coalesce((SELECT list(DISTINCT i.name) FROM nv JOIN iface i ON regexp_matches(lower(nv.value), i.pattern) WHERE nv.shape = x.shape AND nv.path = 'communication.interface'), []) AS faces,
  (SELECT first(value ORDER BY section, nth) FROM nv WHERE nv.shape = x.shape AND {_compact("label")} IN ('package', 'footprint', 'packagecase')) AS package,
  (SELECT first(CAST(regexp_extract(value, '[0-9]+') AS INTEGER) ORDER BY section, nth) FROM nv WHERE nv.shape = x.shape AND regexp_matches(lower(label), '^(number of )?pins?( count)?$')) AS pin_count
  FROM {identity.PER_PART.format("idw")}),
rc AS (SELECT *, (p_partkey // 12) % 8 AS form FROM pg),
r AS (SELECT *, CASE form WHEN 1 THEN 'ALT-' || p_partkey WHEN 2 THEN title WHEN 3 THEN 'D' || p_partkey WHEN 5 THEN 'R' WHEN 6 THEN 'Conn_' || p_partkey ELSE code END AS symbol, CASE WHEN form IN (1, 5, 6) THEN [code] WHEN form = 3 THEN ['DISPLAY-KIT'] ELSE CAST([] AS VARCHAR[]) END AS ra,
  CASE WHEN form IN (0, 7) THEN [p_brand] WHEN form = 4 THEN ['Other Corp'] ELSE CAST([] AS VARCHAR[]) END AS makers, CASE form WHEN 0 THEN '{components.URL}' || lower(code) || '.pdf' WHEN 1 THEN '{components.URL}other1234.pdf' WHEN 2 THEN 'https://mirror.example.net/' || lower(code) || '-sheet.pdf' WHEN 7 THEN 'https://other.example.net/zz9999.pdf' END AS ds,
  CASE form WHEN 0 THEN 'digital part with I2C' WHEN 3 THEN 'peripheral ' || p_partkey WHEN 7 THEN 'CAN transceiver' WHEN 1 THEN 'sensor element' ELSE 'part' END AS words, CASE form WHEN 0 THEN ['i2c', 'digital'] WHEN 7 THEN ['can'] ELSE CAST([] AS VARCHAR[]) END AS rfaces,
  CASE form WHEN 0 THEN 'SOT* SOIC*' WHEN 6 THEN 'QFN*' END AS filters, CASE WHEN form IN (0, 4) THEN 3 WHEN form = 6 THEN 8 ELSE 0 END AS pins, form = 6 OR (form = 2 AND regexp_matches(title, '\\bConnector\\b')) AS plug FROM rc),
k1 AS (SELECT p_partkey AS record, form, symbol, ra, makers, ds, words, rfaces, filters, pins, plug, list_transform([symbol] || ra, lambda x: {_compact("x")}) AS keys FROM r),
k AS (SELECT * FROM k1 UNION ALL SELECT record + {TWIN}, k1.* EXCLUDE (record) FROM k1 WHERE form = 0),
asks AS (SELECT p_partkey AS query, 1 AS rank, lower(unnest(pns || ics)) AS key FROM pg UNION SELECT p_partkey, 2, lower(unnest(pns || ics || pids || aliases)) FROM pg UNION SELECT p_partkey, 3, {_compact("unnest([title] || pids || aliases)")} FROM pg),
bears AS (SELECT record, 1 AS rank, lower(symbol) AS key FROM k UNION SELECT record, 2, lower(unnest(ra)) FROM k WHERE symbol <> 'R' UNION SELECT record, 3, unnest(keys) FROM k WHERE symbol <> 'R'),
said AS (SELECT query, record, count(*) AS shared FROM (SELECT p_partkey AS query, unnest(list_distinct({_tokens("title")})) AS t FROM pg) JOIN (SELECT record, unnest(list_distinct({_tokens("words")})) AS t FROM k WHERE symbol <> 'R') USING (t) GROUP BY 1, 2),
near AS (SELECT query, record, min(rank) AS rank FROM (SELECT query, record, rank FROM asks JOIN bears USING (rank, key) WHERE key <> '' UNION ALL SELECT query, record, 4 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, record) AS rn FROM said) WHERE rn <= 100) GROUP BY 1, 2),
n100 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, record) AS rn FROM near) WHERE rn <= 100),
h AS (SELECT pg.*, query, ['exact', 'alias', 'name', 'description'][rank] AS basis, k.*, list_transform(list_filter(lines, lambda x: {_overlap("keys", "list_transform(regexp_extract_all(lower(x), '[a-z0-9]+(?:[-_./][a-z0-9]+)*'), lambda t: " + _compact("t") + ")")}), lambda x: lower(x)) AS mentions
  FROM n100 JOIN pg ON query = p_partkey JOIN k USING (record)),
rel AS (SELECT *, CASE WHEN kind = 'connector' AND plug THEN 'connector' WHEN {_overlap("keys", "list_transform(pns, lambda x: " + _compact("x") + ")")} THEN 'exact_component'
  WHEN {_overlap("keys", "list_transform(ics, lambda x: " + _compact("x") + ")")} THEN CASE WHEN kind IN ('module', 'development_board') THEN 'main_integrated_circuit' ELSE 'exact_component' END
  WHEN list_contains(keys, {_compact("title")}) AND kind IN ('discrete_component', 'integrated_circuit') THEN 'exact_component' WHEN plug AND len(mentions) > 0 THEN 'connector'
  WHEN len(list_filter(mentions, lambda x: regexp_matches(x, '\\b(?:based on|built around|contains|equipped with|main ic|onboard|on-board|uses)\\b'))) > 0 THEN 'onboard_component' ELSE 'functional_equivalent' END AS relation,
  CASE basis WHEN 'exact' THEN 700 WHEN 'alias' THEN 520 WHEN 'name' THEN 100 ELSE 40 END AS w_basis, CASE WHEN len(mentions) > 0 THEN 150 ELSE 0 END AS w_mention, CASE WHEN list_contains(keys, {_compact("title")}) THEN 100 ELSE 0 END AS w_name,
  CASE WHEN maker IS NULL OR len(makers) = 0 THEN 0 WHEN list_contains(makers, maker) THEN 50 ELSE -500 END AS w_maker,
  CASE WHEN ds IS NULL OR len(dss) = 0 THEN 0 WHEN list_contains(dss, ds) THEN 80 WHEN {_overlap(_ds("ds"), "flatten(list_transform(dss, lambda u: " + _ds("u") + "))")} THEN 60
   WHEN list_contains(list_transform(dss, lambda u: regexp_extract(u, '//([^/]+)', 1)), regexp_extract(ds, '//([^/]+)', 1)) THEN 30 WHEN len({_ds("ds")}) > 0 AND len(flatten(list_transform(dss, lambda u: {_ds("u")}))) > 0 THEN -120 ELSE 0 END AS w_ds,
  CASE WHEN len(faces) = 0 OR len(rfaces) = 0 THEN 0 WHEN {_overlap("faces", "rfaces")} THEN 40 ELSE -180 END AS w_face, CASE WHEN package IS NULL OR filters IS NULL THEN 0 WHEN {_overlap(_pk("package"), _pk("filters"))} THEN 50 ELSE -250 END AS w_pack,
  CASE WHEN pin_count IS NULL OR pins = 0 THEN 0 WHEN pin_count = pins THEN 50 ELSE -250 END AS w_pins FROM h),
sc AS (SELECT *, greatest(0, least(1000, w_basis + w_mention + w_name + w_maker + w_ds + w_face + w_pack + w_pins)) AS score,
  len(mentions) + CASE WHEN w_maker > 0 THEN 1 ELSE 0 END + CASE WHEN w_ds > 0 THEN 1 ELSE 0 END + CASE WHEN w_face > 0 THEN 1 ELSE 0 END + CASE WHEN w_pack > 0 THEN 1 ELSE 0 END + CASE WHEN w_pins > 0 THEN 1 ELSE 0 END AS proof FROM rel),
dc AS (SELECT *, CASE WHEN w_maker < 0 OR w_pack < 0 OR w_pins < 0 THEN 'rejected' WHEN relation = 'exact_component' AND basis = 'exact' AND w_ds >= 0 AND w_face >= 0 AND proof >= 2 AND score >= 950 THEN 'auto_accepted' WHEN score < 450 THEN 'rejected' ELSE 'review' END AS decision FROM sc)"""


@query("""SELECT CAST(count(*) FILTER (WHERE o.h = n.h) AS BIGINT) AS reused, CAST(count(*) FILTER (WHERE o.h <> n.h) AS BIGINT) AS changed, CAST(count(*) FILTER (WHERE o.h IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE n.h IS NULL) AS BIGINT) AS removed
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0) o FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) n ON o.doc_id = n.doc_id""")
def idx_build(spark, sf_dir):
    """Incremental build between two snapshots: what is reused, changed, added and removed."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("o"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("n"))
    both = old.join(new, "doc_id", "full")
    return both.agg(F.count_if(F.col("o") == F.col("n")).alias("reused"), F.count_if(F.col("o") != F.col("n")).alias("changed"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"))


@query(f"WITH {HITS} SELECT query, record, basis, coalesce(list_contains(makers, maker), false) AS same_maker FROM h")
def idx_lookup(spark, sf_dir):
    """Hits by the best basis, annotated with the manufacturer; generic records only where exact."""
    return scored(spark, sf_dir).select("query", "record", "basis", "same_maker")


@query(f"WITH {HITS} SELECT query, record, relation FROM sc")
def match_relation_type(spark, sf_dir):
    """The first of seven conditions."""
    return scored(spark, sf_dir).select("query", "record", "relation")


@query(f"WITH {HITS} SELECT query, record, CAST(score AS INTEGER) AS score FROM sc")
def match_score(spark, sf_dir):
    """Sum of signed contributions, clamped."""
    return scored(spark, sf_dir).select("query", "record", "score")


@query(f"WITH {HITS} SELECT query, record, decision FROM dc")
def match_decision(spark, sf_dir):
    """Severe conflicts reject; only exact, unopposed, doubly evidenced matches from 950 are accepted; below 450 rejected."""
    return scored(spark, sf_dir).select("query", "record", "decision")


for _name in ("idx_lookup", "match_relation_type", "match_score", "match_decision"):  # their names while only a part of the pages asked
    also(f"{_name}_all", of=_name)
