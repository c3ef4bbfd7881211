"""Quality scoring: weighted dimensions in per mille, issues, and the route.

Inputs are the facts of a page, its identity, and what matching found for it;
every dimension is ``when`` arithmetic on them, the publication dimension takes
the issues of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the nine dimensions (sum 1000) and route thresholds.
WEIGHTS = {"identity": 150, "description": 120, "specifications": 150, "pinout": 80, "provenance": 150, "conflicts": 120, "enrichment": 80, "educational": 80, "publication": 70}
REJECT, READY = 500, 800
# What a profile expects: code, evidence in the source, and the fact that satisfies it.
EXPECTED = {
    "display": [("quality.profile.display.interface_missing", r"\b(?:i2c|i²c|spi|interface)\b", "interface"), ("quality.profile.display.resolution_missing", r"\bresolution\b|\b\d{2,4}\s*[x×]\s*\d{2,4}\b", "resolution")],
    "sensor": [("quality.profile.sensor.quantity_missing", r"\b(?:temperature|humidity|pressure|distance|range|sensor)\b", "quantity"), ("quality.profile.sensor.range_missing", r"\b(?:measurement|measuring|temperature|humidity|pressure)?\s*range\b", "range")],
    "board": [("quality.profile.board.mcu_missing", r"\b(?:mcu|microcontroller|processor|esp32|atmega|rp2040)\b", "ic"), ("quality.profile.board.power_missing", r"\b(?:power|supply|voltage|vcc|vin)\b", "power"), ("quality.profile.board.interface_missing", r"\b(?:i2c|spi|uart|usb|wi-?fi|bluetooth|interface)\b", "interface")],
    "actuator": [("quality.profile.actuator.power_missing", r"\b(?:power|supply|voltage|current|vcc|vin)\b", "power"), ("quality.profile.actuator.control_missing", r"\b(?:i2c|spi|pwm|digital|interface|control)\b", "interface")],
    "communication": [("quality.profile.communication.interface_missing", r"\b(?:can|i2c|spi|uart|lora|radio|interface)\b", "interface"), ("quality.profile.communication.frequency_missing", r"\b(?:frequency|mhz|ghz|band)\b", "frequency")],
}
DESCRIBED = r"\bdescription\b|\boverview\b|\bintroduction\b"
PINNED = r"\bpin(?:out| map| definition| assignment|s)?\b|\b(?:sda|scl|vcc|gnd)\b"


def satisfied() -> dict[str, Column]:
    """Whether the facts hold what an expectation asks for."""
    some = lambda test: F.exists("paths", test)
    return {
        "interface": F.size("interfaces") > 0, "resolution": F.array_contains("paths", "display.resolution"), "quantity": some(lambda p: p.startswith("sensor.") | p.startswith("measurement.")),
        "range": some(lambda p: F.contains(p, F.lit("range"))), "ic": F.size("ics") > 0, "power": some(lambda p: p.startswith("electrical.voltage")), "frequency": some(lambda p: F.contains(p, F.lit("frequency"))),
    }


def in_source(pattern: str) -> Column:
    return F.exists("lines", lambda x: F.lower(x).rlike(pattern))


def expectations() -> Column:
    """(code, met, in_source) of the page's profile."""
    met = satisfied()
    out = F.array().cast("array<struct<code:string,met:boolean,in_source:boolean>>")
    for profile, rows in EXPECTED.items():
        own = F.array(*[F.struct(F.lit(code).alias("code"), met[need].alias("met"), in_source(pattern).alias("in_source")) for code, pattern, need in rows])
        out = F.when(F.col("profile") == profile, own).otherwise(out)
    return out


def dimensions() -> dict[str, Column]:
    """Scores of the first eight dimensions from the input columns."""
    c = F.col
    n = lambda x: F.size(x)
    unmet = F.transform("expected", lambda e: F.when(e["met"], 1000).when(e["in_source"], 250).otherwise(700))
    general = F.when(c("n_mapped") >= 2, 1000).when(c("n_mapped") == 1, 850).otherwise(700)
    marks = F.concat(F.when(n("expected") > 0, unmet).otherwise(F.array(general)), F.when(c("n_unmapped") > 0, F.array(F.greatest(F.lit(300), 1000 - c("n_unmapped") * 150))).otherwise(F.array().cast("array<int>")))
    whole = lambda a: F.floor(F.aggregate(a, F.lit(0), lambda t, x: t + x) / n(a)).cast("int")
    learning = sum((F.when(x, w).otherwise(0) for x, w in ((n("features") > 0, 200), (n("applications") > 0, 200), (c("n_usages") > 0, 200), (n("resources") > 0, 150))), F.when(c("has_text"), 250).otherwise(0))
    return {
        "identity": F.when(c("status") == "auto", 1000).when(c("status") == "review", 650).otherwise(200),
        "description": F.when(c("has_summary") & c("has_description"), 1000).when(c("has_text"), 750).when(c("described"), 250).otherwise(550),
        "specifications": whole(marks),
        "pinout": F.when(~c("wants_pins") | (c("n_pins") > 0), 1000).when(c("pinned"), 200).otherwise(750),
        "provenance": F.when(n("lines") == 0, 0).otherwise(1000 - F.when(c("revision").isNull(), 250).otherwise(0)),
        "conflicts": F.greatest(F.lit(0), 1000 - 350 * n("clashes") - 100 * c("n_extraction") - 120 * n("warnings") - F.when(c("n_accepted") > 1, 500).otherwise(0) - c("opposed")),
        "enrichment": F.coalesce(c("best_accepted"), F.least(F.lit(850), c("best_review")), F.when(n("ics") > 0, 400).otherwise(1000)),
        "educational": learning,
    }


def issues() -> tuple[Column, Column]:
    """How many blocking issues and warnings the first eight dimensions raise."""
    c = F.col
    one = lambda x: F.when(x, 1).otherwise(0)
    blocking = one(c("status") == "unresolved") + one(F.size("lines") == 0) + F.size("clashes") + one(c("n_accepted") > 1)
    missed = F.size(F.filter("expected", lambda e: ~e["met"] & e["in_source"]))
    warnings = (
        one(c("status") == "review") + one(~(c("has_summary") & c("has_description")) & c("described")) + missed + one(c("n_unmapped") > 0) + one(c("wants_pins") & (c("n_pins") == 0) & c("pinned"))
        + one(c("revision").isNull()) + c("n_extraction") + F.size("warnings") + c("n_opposed") + one(c("best_accepted").isNull() & (c("best_review").isNotNull() | (F.size("ics") > 0)))
    )
    return blocking, warnings


#: Dimensions that matches have no part in.
UNMATCHED = ["identity", "description", "specifications", "pinout", "provenance", "educational"]


def prepared(facts: DataFrame) -> DataFrame:
    """Facts with what the dimensions ask of a page, and its expectations; no matches are needed."""
    c = F.col
    return facts.withColumnRenamed("conflicts", "clashes").withColumns({
        "has_summary": F.size("summaries") > 0, "has_description": c("n_descriptions") > 0, "has_text": (F.size("summaries") > 0) | (c("n_descriptions") > 0), "described": in_source(DESCRIBED), "pinned": in_source(PINNED),
        "wants_pins": c("kind").isin("module", "development_board", "connector"), "n_extraction": F.when(F.size("titles") > 1, 1).otherwise(0), "expected": expectations(),
    })


def evaluated(facts: DataFrame) -> DataFrame:
    """Facts with the nine scores, ``n_blocking``, ``n_warning``, ``overall`` and ``route``."""
    c, out = F.col, prepared(facts)
    blocking, warnings = issues()
    out = out.withColumns(dimensions()).withColumns({"_blocking": blocking, "n_warning": warnings})
    ready = 200 + F.when(c("status") == "auto", 300).when(c("status") == "review", 150).otherwise(0) + F.when(c("has_text"), 250).otherwise(0) + F.when(c("n_mapped") + c("n_unmapped") > 0, 150).otherwise(0) + F.when(c("revision").isNotNull(), 100).otherwise(0)
    out = out.withColumn("publication", F.greatest(F.lit(0), F.least(F.lit(1000), ready - 400 * c("_blocking") - 75 * c("n_warning"))))
    total = sum((w * c(d) for d, w in list(WEIGHTS.items())[1:]), WEIGHTS["identity"] * c("identity"))
    out = out.withColumn("_total", total).withColumn("overall", F.expr("_total div 1000"))
    out = out.withColumn("n_blocking", F.when((c("overall") < REJECT) & (c("_blocking") == 0), 1).otherwise(c("_blocking"))).drop("_total", "_blocking")
    route = F.when((c("overall") < REJECT) | (c("n_blocking") > 0), "reject").when((c("overall") < READY) | (c("n_warning") > 0), "manual_review").otherwise("ready")
    return out.withColumn("route", route)
