"""Identity and classification of component pages: rules scored against fields, margin, status, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import spaced_key
from partwise.plans import components, normalize
from partwise.plans.registry import query, table

# Category, words, taxonomy prefixes, profile, weight of the taxonomy.
CATEGORIES = [
    ("sensors", ["sensor", "sensing", "temperature", "humidity", "pressure", "ultrasonic", "ranger", "distance", "proximity", "accelerometer", "gyroscope", "light sensor", "gas sensor"], ["sensor."], "sensor", 20),
    ("displays", ["display", "oled", "lcd", "screen", "e ink", "epaper"], ["display."], "display", 20),
    ("actuators", ["actuator", "motor", "relay", "servo", "solenoid", "pump", "buzzer"], ["actuator."], "actuator", 20),
    ("input", ["button", "switch", "joystick", "keypad", "encoder", "potentiometer"], [], None, 20),
    ("power", ["battery", "charger", "power supply", "dc dc", "converter", "power module"], [], None, 20),
    ("communication", ["wifi", "wi fi", "bluetooth", "lora", "can bus", "radio", "wireless", "ethernet"], ["communication.frequency.", "communication.link_budget"], "communication", 20),
    ("boards", ["development board", "board", "shield", "xiao", "seeeduino", "wio terminal"], ["board."], "board", 20),
    ("connectors", ["connector", "terminal", "adapter", "socket", "header"], ["mechanical.connector"], None, 10),
    ("semiconductors", ["transistor", "diode", "mosfet", "thyristor", "triac", "led"], [], None, 20),
]
# Kind, words, weight in a title, and in a body (0: bodies don't count).
KINDS = [
    ("development_board", ["development board", "xiao", "seeeduino", "wio terminal", "arduino board"], 70, 20),
    ("connector", ["connector", "terminal", "adapter", "socket", "header"], 70, 20),
    ("discrete_component", ["resistor", "capacitor", "diode", "transistor", "mosfet", "led", "crystal"], 70, 0),
    ("integrated_circuit", ["integrated circuit", "microcontroller", "mcu", "controller ic"], 70, 0),
    ("module", ["grove", "module", "shield", "sensor", "display", "driver", "converter", "button", "relay"], 35, 20),
]
# Weights of title, summary, details and profile; of an exact part; of a known source; thresholds.
TITLE, SUMMARY, DETAILS, PROFILE, EXACT, SOURCE = 55, 20, 10, 15, 85, 15
LEAST, AUTO, MARGIN, SURE_KIND = 35, 65, 15, 50


def said(texts: Column, words: list[str]) -> Column:
    """Whether one of the texts holds one of the words, as a whole."""
    padded = lambda t: F.concat(F.lit(" "), spaced_key(t), F.lit(" "))
    return F.exists(texts, lambda t: padded(t).rlike(" (" + "|".join(words) + ") "))


def points(*parts: tuple[Column, int]) -> Column:
    return sum((F.when(c, F.lit(n)).otherwise(F.lit(0)) for c, n in parts[1:]), F.when(parts[0][0], F.lit(parts[0][1])).otherwise(F.lit(0)))


def ranked(candidates: Column) -> Column:
    """Candidates (name, score) with a score, best first, ties by name."""
    order = F.transform(F.filter(candidates, lambda c: c["score"] > 0), lambda c: F.struct((-c["score"]).alias("s"), c["name"].alias("name")))
    return F.transform(F.array_sort(order), lambda c: F.struct(c["name"].alias("name"), (-c["s"]).cast("long").alias("score")))


def candidates(facts: DataFrame) -> DataFrame:
    """Facts with ``categories`` and ``kinds``, each an array of (name, score), best first."""
    title, summary, details = F.col("titles"), F.col("summaries"), F.col("details")
    exact = F.exists("ics", lambda x: spaced_key(x) == spaced_key(F.col("titles")[0]))
    one = lambda name, score: F.struct(F.lit(name).alias("name"), score.alias("score"))
    cats = []
    for name, words, prefixes, profile, weight in CATEGORIES:
        text = points((said(title, words), TITLE), (said(summary, words), SUMMARY), (said(details, words), DETAILS))
        below = F.exists("paths", lambda p: F.coalesce(*[F.when(p.startswith(x), F.lit(True)) for x in prefixes], F.lit(False))) if prefixes else F.lit(False)
        below = below & (text > 0) if name == "connectors" else below
        cats.append(one(name, F.least(F.lit(100), text + points((below, weight), ((F.col("profile") == profile) if profile else F.lit(False), PROFILE)))))
    cats.append(one("integrated-circuits", points((exact, EXACT))))
    kinds = []
    for name, words, in_title, in_body in KINDS:
        score = points((said(title, words), in_title)) + (points((said(F.concat("summaries", "details"), words), in_body)) if in_body else F.lit(0))
        if name == "connector":
            score = score + points(((score > 0) & F.array_contains("paths", "mechanical.connector"), 10))
        if name == "module":
            score = score + SOURCE
        kinds.append(one(name, F.when(exact, F.lit(EXACT)).otherwise(score) if name == "integrated_circuit" else F.least(F.lit(100), score)))
    return facts.withColumn("categories", ranked(F.array(*cats))).withColumn("kinds", ranked(F.array(*kinds)))


def identities(facts: DataFrame) -> DataFrame:
    """Facts with the best category and kind, margin, status, aliases and warnings."""
    out = candidates(facts)
    best, second = F.get("categories", F.lit(0)), F.get("categories", F.lit(1))
    margin = best["score"] - F.coalesce(second["score"], F.lit(0))
    out = out.withColumns({"category": best["name"], "score": best["score"], "margin": margin, "kind": F.get("kinds", F.lit(0))["name"], "kind_score": F.get("kinds", F.lit(0))["score"]})
    sure = (F.col("score") >= AUTO) & (F.col("margin") > MARGIN) & (F.col("kind_score") >= SURE_KIND) & (F.size("conflicts") == 0) & (F.size("titles") == 1)
    status = F.when(F.col("score").isNull() | (F.col("score") < LEAST) | F.col("kind").isNull(), "unresolved").when(sure, "auto").otherwise("review")
    codes = F.array_compact(F.array(
        F.when(F.col("status") == "unresolved", F.lit("identity_unresolved")).when(F.col("status") == "review", F.lit("identity_review_required")),
        F.when((F.size("categories") > 1) & (F.col("margin") <= MARGIN), F.lit("category_ambiguous")), F.when(F.size("conflicts") > 0, F.lit("normalization_conflict_present")),
    ))
    other = lambda v: spaced_key(v) != spaced_key(F.col("titles")[0])
    known_ic = lambda v: F.exists("ics", lambda x: spaced_key(x) == spaced_key(v))
    aliases = F.array_distinct(F.concat(F.filter(F.slice("titles", F.lit(2), F.greatest(F.size("titles") - 1, F.lit(0))), other), F.filter("models", lambda v: other(v) & ~known_ic(v))))
    return out.withColumn("status", status).withColumn("warnings", codes).withColumn("aliases", aliases)


_pad = "(' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' ')"
_said = lambda texts: f"len(list_filter({texts}, lambda t: regexp_matches({_pad.format('t')}, words))) > 0"
_words = lambda words: "' (" + "|".join(words) + ") '"
#: Candidates, status and warnings of every shape.
IDENTITY = f"""{normalize.SPECS},
cr(category, words, prefixes, profile, weight) AS (VALUES {", ".join(f"('{c}', {_words(w)}, {components.sql_list(p)}, {components.sql_text(f)}, {n})" for c, w, p, f, n in CATEGORIES)}),
kr(kind, words, in_title, in_body) AS (VALUES {", ".join(f"('{k}', {_words(w)}, {a}, {b})" for k, w, a, b in KINDS)}),
sx AS (SELECT sh.*, p.profile, coalesce(n_conflicts, 0) AS n_conflicts, list_contains(list_transform(ics, lambda x: lower(x)), lower(title)) AS exact,
  coalesce((SELECT list(DISTINCT path) FROM nv WHERE nv.shape = sh.shape AND path IS NOT NULL), []) AS paths FROM sh JOIN prof p ON sh.shape = p.shape LEFT JOIN conf c ON sh.shape = c.shape),
ct AS (SELECT shape, category, sx.profile = cr.profile AS fits, weight, CASE WHEN {_said("titles")} THEN 55 ELSE 0 END + CASE WHEN {_said("summaries")} THEN 20 ELSE 0 END + CASE WHEN {_said("details")} THEN 10 ELSE 0 END AS pts,
  len(list_filter(paths, lambda q: len(list_filter(prefixes, lambda x: starts_with(q, x))) > 0)) > 0 AS below FROM sx, cr),
cs AS (SELECT shape, category, least(100, pts + CASE WHEN below AND (category <> 'connectors' OR pts > 0) THEN weight ELSE 0 END + CASE WHEN fits THEN 15 ELSE 0 END) AS score FROM ct UNION ALL SELECT shape, 'integrated-circuits', 85 FROM sx WHERE exact),
ck AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY score DESC, category) AS rn FROM cs WHERE score > 0),
kt AS (SELECT shape, kind, exact, CASE WHEN {_said("titles")} THEN in_title ELSE 0 END + CASE WHEN {_said("summaries || details")} THEN in_body ELSE 0 END AS pts, list_contains(paths, 'mechanical.connector') AS plug FROM sx, kr),
ks AS (SELECT shape, kind, CASE WHEN kind = 'integrated_circuit' AND exact THEN 85 ELSE least(100, pts + CASE WHEN kind = 'connector' AND pts > 0 AND plug THEN 10 WHEN kind = 'module' THEN 15 ELSE 0 END) END AS score FROM kt),
kk AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY score DESC, kind) AS rn FROM ks WHERE score > 0),
idn AS (SELECT sx.*, a.category, CAST(a.score AS BIGINT) AS score, CAST(a.score - coalesce(b.score, 0) AS BIGINT) AS margin, b.score IS NOT NULL AS several, k.kind, CAST(k.score AS BIGINT) AS kind_score
  FROM sx LEFT JOIN ck a ON sx.shape = a.shape AND a.rn = 1 LEFT JOIN ck b ON sx.shape = b.shape AND b.rn = 2 LEFT JOIN kk k ON sx.shape = k.shape AND k.rn = 1),
ids AS (SELECT *, CASE WHEN score IS NULL OR score < 35 OR kind IS NULL THEN 'unresolved' WHEN score >= 65 AND margin > 15 AND kind_score >= 50 AND n_conflicts = 0 AND len(titles) = 1 THEN 'auto' ELSE 'review' END AS status FROM idn),
idw AS (SELECT *, list_filter([CASE status WHEN 'unresolved' THEN 'identity_unresolved' WHEN 'review' THEN 'identity_review_required' END, CASE WHEN several AND margin <= 15 THEN 'category_ambiguous' END, CASE WHEN n_conflicts > 0 THEN 'normalization_conflict_present' END], lambda x: x IS NOT NULL) AS warnings,
  titles[2:] || list_filter(models, lambda m: NOT list_contains(ics, m)) AS aliases FROM ids)"""
PER_PART = f"part JOIN {{0}} x ON p_partkey % {components.N} = x.shape"


@query(f"WITH {IDENTITY} SELECT p_partkey, category, CAST(score AS BIGINT) AS score FROM {PER_PART.format('ck')}")
def id_category(spark, sf_dir):
    """Category candidates by the nine weighted rules and the exact part."""
    rows = candidates(normalize.facts(spark, sf_dir)).select("p_partkey", F.explode("categories").alias("c"))
    return rows.select("p_partkey", F.col("c.name").alias("category"), "c.score")


@query(f"WITH {IDENTITY} SELECT p_partkey, category, score, margin, status FROM {PER_PART.format('idw')}")
def id_resolution(spark, sf_dir):
    """Best category with its margin over the runner-up, and the status."""
    return identities(normalize.facts(spark, sf_dir)).select("p_partkey", "category", "score", "margin", "status")


@query(f"WITH {IDENTITY} SELECT p_partkey, kind, CAST(score AS BIGINT) AS score, CAST(rn AS INTEGER) AS rank FROM {PER_PART.format('kk')}")
def id_kind(spark, sf_dir):
    """Kind candidates by the five rules."""
    rows = candidates(normalize.facts(spark, sf_dir)).select("p_partkey", F.posexplode("kinds").alias("n", "k"))
    return rows.select("p_partkey", F.col("k.name").alias("kind"), "k.score", (F.col("n") + 1).cast("int").alias("rank"))


@query("""SELECT n_nationkey, array_to_string(list_filter([lower(n_name), replace(lower(n_name), ' ', '-'), substr(lower(n_name), 1, 4)], lambda x, i: list_position([lower(n_name), replace(lower(n_name), ' ', '-'), substr(lower(n_name), 1, 4)], x) = i), ',') AS aliases FROM nation""")
def id_aliases(spark, sf_dir):
    """Distinct aliases, first occurrence first."""
    low = F.lower("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.array_distinct(F.array(low, F.replace(low, F.lit(" "), F.lit("-")), F.substring(low, 1, 4))), ",").alias("aliases"))


@query(f"WITH {IDENTITY} SELECT p_partkey, array_to_string(warnings, ',') AS warnings, replace(array_to_string(aliases, ','), '{{k}}', p_partkey::VARCHAR) AS aliases FROM {PER_PART.format('idw')}")
def id_warnings(spark, sf_dir):
    """Warning codes of the resolution, and the aliases that it keeps."""
    return identities(normalize.facts(spark, sf_dir)).select("p_partkey", F.array_join("warnings", ",").alias("warnings"), F.array_join("aliases", ",").alias("aliases"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), '/en') THEN 'english' WHEN contains(lower(url), '/de') THEN 'german' WHEN contains(lower(url), '/fr') THEN 'french' ELSE 'other' END AS category FROM pages""")
def id_category_v1(spark, sf_dir):
    """The older form: first keyword that occurs as a substring."""
    words = [("/en", "english"), ("/de", "german"), ("/fr", "french")]
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(*[F.when(F.contains(F.lower("url"), F.lit(w)), F.lit(c)) for w, c in words], F.lit("other")).alias("category"))
