"""Specification normalization: profile, registry look-up, values, conflicts, taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions import text as fn
from partwise.functions.text import INTERFACES, interfaces
from partwise.operators import specs, tables
from partwise.plans import components
from partwise.plans.registry import query, table

REGISTRY = "reg(path, alias, kind, profile) AS (VALUES " + ", ".join(f"('{path}', '{alias}', '{kind}', {components.sql_text(profile)})" for path, aliases, kind, profile in specs.DEFINITIONS for alias in aliases) + ")"
PROFILE = "prof AS (SELECT shape, CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{pattern}') THEN '{name}'" for name, pattern in specs.PROFILES) + " ELSE 'generic' END AS profile FROM (SELECT shape, array_to_string(titles || summaries || features || applications, ' ') AS t FROM sh))"
FACES = "iface(name, pattern) AS (VALUES " + ", ".join(f"('{name}', '{pattern}')" for name, pattern in INTERFACES) + ")"
_number = "replace(CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END, '+', '')"
#: Specifications of the shapes with path, kind and normalized value (null path: unmapped).
SPECS = f"""{components.SHAPE_ROWS}, {components.SPEC_ROWS}, {REGISTRY}, {PROFILE}, {FACES},
units(u, symbol) AS (VALUES ('v', 'V'), ('a', 'A'), ('mhz', 'MHz'), ('c', 'c')),
ns AS (SELECT sp.shape, sp.section, sp.nth, sp.label, sp.value, p.profile, coalesce(own.path, gen.path) AS path, coalesce(own.kind, gen.kind, 'text') AS kind
  FROM sp JOIN prof p ON sp.shape = p.shape LEFT JOIN reg own ON own.alias = lower(label) AND own.profile = p.profile LEFT JOIN reg gen ON gen.alias = lower(label) AND gen.profile IS NULL),
nq AS (SELECT ns.*, CASE WHEN kind NOT IN ('text', 'dimensions', 'interface') THEN (SELECT CASE WHEN regexp_matches(value, '^[-+0-9.]+ to ') THEN regexp_extract(value, '^([-+0-9.]+) to ([-+0-9.]+) ', 1) || '..' || regexp_extract(value, '^([-+0-9.]+) to ([-+0-9.]+) ', 2) ELSE regexp_extract(value, '^([-+0-9.]+) ', 1) END || ' ' || symbol FROM units WHERE u = lower(regexp_extract(value, '([A-Za-z]+)$', 1)) AND regexp_matches(value, '^[-+0-9.]+ '))
  WHEN kind = 'interface' THEN (SELECT string_agg(name, ',' ORDER BY name) FROM iface WHERE regexp_matches(lower(value), pattern)) END AS known FROM ns),
nv AS (SELECT *, coalesce(known, value) AS normalized FROM nq),
conf AS (SELECT shape, count(*) AS n_conflicts FROM (SELECT shape, path FROM nv WHERE path IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT normalized) >= 2 AND count(DISTINCT section) >= 2) GROUP BY 1)"""


def facts(spark, sf_dir) -> DataFrame:
    """Facts of the pages with profile, normalized specifications, interfaces and conflicts."""
    searchable = F.concat_ws(" ", F.array_join("titles", " "), F.array_join("summaries", " "), F.array_join("features", " "), F.array_join("applications", " "))
    rows = components.facts(spark, sf_dir).withColumn("profile", specs.first_profile(searchable))
    found = F.transform("specs", lambda s: F.struct(s["section"].alias("section"), s["label"].alias("label"), s["value"].alias("value"), specs.definition(s["label"], F.col("profile")).alias("d")))
    rows = rows.withColumn("specs", F.transform(found, lambda s: F.struct(s["section"].alias("section"), s["label"].alias("label"), s["value"].alias("value"), s["d"]["path"].alias("path"), specs.normal_value(s["value"], F.coalesce(s["d"]["kind"], F.lit("text"))).alias("normalized"))))
    mapped = F.filter("specs", lambda s: s["path"].isNotNull())
    rows = tables.stored(rows, "facts")
    paths = F.array_distinct(F.transform(mapped, lambda s: s["path"]))
    same = lambda p, field: F.size(F.array_distinct(F.transform(F.filter("specs", lambda s: s["path"] == p), lambda s: s[field].cast("string"))))
    said = F.filter("specs", lambda s: s["path"] == "communication.interface")
    return rows.withColumns({
        "paths": paths, "n_mapped": F.size(mapped), "n_unmapped": F.size("specs") - F.size(mapped), "conflicts": F.filter(paths, lambda p: (same(p, "normalized") >= 2) & (same(p, "section") >= 2)),
        "interfaces": F.array_distinct(F.flatten(F.transform(said, lambda s: interfaces(s["value"])))),
    })


def raw_specs(spark, sf_dir):
    """Raw label/value strings made from part numbers (the texts hold no quantities)."""
    size = F.col("p_size")
    kind = size % 4
    label = F.when(kind == 0, "Operating voltage").when(kind == 1, "Supply current").when(kind == 2, "Bus").otherwise("Colour")
    value = F.when(kind == 0, F.concat(size, F.lit(" to "), size + 5, F.lit(" volts"))).when(kind == 1, F.concat(size, F.lit(" mA"))).when(kind == 2, "IIC").otherwise("red")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", label.alias("label"), value.alias("value"))


@query(f"""WITH {SPECS} SELECT p_partkey, profile FROM part JOIN prof ON p_partkey % {components.N} = shape""")
def norm_profile(spark, sf_dir):
    """The first profile whose pattern the page's titles, summaries, features and applications hold, else generic."""
    return facts(spark, sf_dir).select("p_partkey", "profile")


@query(f"""WITH {SPECS} SELECT p_partkey, CAST(section AS INTEGER) AS nth_table, label, coalesce(path, 'unmapped') AS path, replace(normalized, '{{k}}', p_partkey::VARCHAR) AS normalized FROM part JOIN nv ON p_partkey % {components.N} = shape""")
def norm_specs(spark, sf_dir):
    """Registry look-up (profile first), value parsing; unmapped facts are kept."""
    first = F.array_min(F.transform("specs", lambda s: s["section"]))
    rows = facts(spark, sf_dir).select("p_partkey", first.alias("first"), F.explode("specs").alias("s"))
    return rows.select("p_partkey", (F.col("s.section") - F.col("first")).cast("int").alias("nth_table"), "s.label", F.coalesce("s.path", F.lit("unmapped")).alias("path"), "s.normalized")


@query("""SELECT p_partkey, unnest(string_split(CASE p_size % 3 WHEN 0 THEN 'i2c,spi' WHEN 1 THEN 'uart' ELSE 'unmapped' END, ',')) AS interface FROM part""")
def norm_interfaces(spark, sf_dir):
    """Every interface that a text names, or one unmapped fact."""
    kind = F.col("p_size") % 3
    said = F.when(kind == 0, "TWI or SPI").when(kind == 1, "serial port").otherwise("wireless")
    found = fn.interfaces(said)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unmapped")))).alias("interface"))


def mapped_facts(spark, sf_dir):
    """(p_partkey, section, nth, label, path, normalized) of the facts of all pages that the registry knows."""
    rows = facts(spark, sf_dir).select("p_partkey", F.posexplode("specs").alias("nth", "s"))
    return rows.select("p_partkey", "s.section", "nth", "s.label", "s.path", "s.normalized").where("path IS NOT NULL")


_facts = f"""WITH {SPECS}, mf AS (SELECT p_partkey, section, nth, label, path, replace(normalized, '{{k}}', p_partkey::VARCHAR) AS normalized FROM part JOIN nv ON p_partkey % {components.N} = shape WHERE path IS NOT NULL)"""


@query(_facts + """ SELECT p_partkey, path, count(DISTINCT normalized) AS n_values, count(DISTINCT section) AS n_sections FROM mf GROUP BY 1, 2 HAVING count(DISTINCT normalized) >= 2 AND count(DISTINCT section) >= 2""")
def norm_conflicts(spark, sf_dir):
    """Paths for which two sections of a page give unlike values."""
    out = mapped_facts(spark, sf_dir).groupBy("p_partkey", "path").agg(F.countDistinct("normalized").alias("n_values"), F.countDistinct("section").alias("n_sections"))
    return out.where("n_values >= 2 AND n_sections >= 2")


@query(_facts + """ SELECT p_partkey, path, normalized, count(*) AS n_evidence, string_agg(label, ' | ' ORDER BY section, nth) AS evidence FROM mf GROUP BY 1, 2, 3""")
def norm_merge(spark, sf_dir):
    """Equal facts of a page merged, their labels in order (a page's own facts are a short list)."""
    labels = F.transform(F.sort_array(F.collect_list(F.struct("section", "nth", "label"))), lambda x: x["label"])
    return mapped_facts(spark, sf_dir).groupBy("p_partkey", "path", "normalized").agg(F.count("*").alias("n_evidence"), F.array_join(labels, " | ").alias("evidence"))


@query(_facts + """, b AS (SELECT DISTINCT path, array_to_string(s[1:i], '.') AS branch FROM (SELECT path, s, unnest(range(1, len(s))) AS i FROM (SELECT DISTINCT path, string_split(path, '.') AS s FROM reg)))
SELECT branch, count(mf.p_partkey) AS n_facts, count(DISTINCT mf.p_partkey) AS n_pages FROM b LEFT JOIN mf ON mf.path = b.path GROUP BY 1""")
def norm_taxonomy_branches(spark, sf_dir):
    """Every branch of the taxonomy (a proper prefix of a dotted path) with the facts and pages under it."""
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    under = specs.registry(spark).select("path").distinct().where(F.size(parts) > 1).select("path", F.explode(prefixes).alias("branch"))
    counted = mapped_facts(spark, sf_dir).groupBy("path", "p_partkey").agg(F.count("*").alias("n"))
    return under.join(counted, "path", "left").groupBy("branch").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"), F.countDistinct("p_partkey").alias("n_pages"))


@query(f"""WITH {REGISTRY} SELECT count(*) AS overlaps, count(*) = 0 AS valid FROM reg r JOIN reg q ON r.alias = q.alias AND r.path < q.path AND (r.profile = q.profile OR (r.profile IS NULL AND q.profile IS NULL))""")
def norm_registry_check(spark, sf_dir):
    """No two definitions may share an alias within a profile, or both be for all."""
    a = specs.registry(spark).select("path", "alias", "profile")
    b = a.select(F.col("path").alias("p2"), F.col("alias").alias("a2"), F.col("profile").alias("f2"))
    clash = a.join(b, (F.col("alias") == F.col("a2")) & F.col("profile").eqNullSafe(F.col("f2")) & (F.col("path") < F.col("p2")))
    return clash.agg(F.count("*").alias("overlaps")).withColumn("valid", F.col("overlaps") == 0)
