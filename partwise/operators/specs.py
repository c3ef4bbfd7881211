"""Specification registry and normalization: label and profile to a taxonomy path, values by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions.text import interfaces, quantity, spaced_key

# Taxonomy path, aliases, kind of value, profile (none: for all).
DEFINITIONS = [
    ("sensor.temperature.measurement_range", ["temperature range"], "temperature", "sensor"),
    ("environment.temperature.operating_range", ["operating temperature", "operating temperature range", "operation temperature", "temperature range", "working temperature"], "temperature", None),
    ("sensor.humidity.measurement_range", ["humidity range"], "percent", "sensor"),
    ("sensor.pressure.measurement_range", ["pressure range"], "pressure", "sensor"),
    ("display.resolution", ["resolution"], "dimensions", "display"),
    ("measurement.resolution", ["resolution"], "text", None),
    ("communication.frequency.carrier", ["frequency", "operating frequency"], "frequency", "communication"),
    ("signal.frequency", ["frequency", "operating frequency", "sampling frequency"], "frequency", None),
    ("actuator.current.maximum_output", ["maximum current", "max current"], "current", "actuator"),
    ("electrical.current.maximum", ["maximum current", "max current"], "current", None),
    ("electrical.voltage.supply", ["input voltage", "rated voltage", "supply", "supply voltage", "voltage", "working voltage"], "voltage", None),
    ("electrical.voltage.operating", ["operating voltage", "operation voltage", "operational voltage"], "voltage", None),
    ("electrical.current.operating", ["current", "current consumption", "operating current", "operation current", "working current"], "current", None),
    ("electrical.efficiency", ["efficiency"], "percent", None),
    ("measurement.range", ["detection range", "measuring range", "measurement range", "operating range", "range", "sensing range"], "auto", None),
    ("measurement.accuracy", ["accuracy", "measurement accuracy"], "auto", None),
    ("physical.dimensions", ["dimension", "dimensions", "product size", "size"], "dimensions", None),
    ("communication.interface", ["bus", "communication interface", "interface", "interfaces", "protocol"], "interface", None),
    ("mechanical.connector", ["connector", "connector type"], "text", None),
    ("identity.primary_ic", ["chip", "controller", "main chip", "main ic", "mcu", "primary ic", "sensor ic"], "text", None),
    ("display.color", ["display color", "colour", "color"], "text", "display"),
    ("communication.link_budget", ["link budget"], "text", "communication"),
    ("board.processor", ["processor", "cpu"], "text", "board"),
]
# Profiles by the first pattern that a page's titles, summaries, features and applications hold.
PROFILES = [
    ("display", r"\b(?:display|lcd|oled|screen)\b"),
    ("communication", r"\b(?:can bus|communication|lora|radio|wireless)\b"),
    ("actuator", r"\b(?:actuator|motor|relay|servo)\b"),
    ("sensor", r"\b(?:sensor|sensing|temperature|humidity|pressure|ranger)\b"),
    ("board", r"\b(?:board|xiao|shield|microcontroller)\b"),
]
UNTYPED = ("text", "dimensions", "interface")


def registry(spark: SparkSession) -> DataFrame:
    """path, alias, kind, profile: one row per alias."""
    return spark.createDataFrame([(path, alias, kind, profile) for path, aliases, kind, profile in DEFINITIONS for alias in aliases], "path string, alias string, kind string, profile string")


def first_profile(text: Column, rules: list[tuple[str, str]] = PROFILES, default: str = "generic") -> Column:
    return F.coalesce(*[F.when(F.lower(text).rlike(pattern), F.lit(name)) for name, pattern in rules], F.lit(default))


def definition(label: Column, profile: Column) -> Column:
    """(path, kind) of a label: the profile's own definition first, then the general one; null if there is none."""
    known = [(f"{profile or ''}|{alias}", path, kind) for path, aliases, kind, profile in DEFINITIONS for alias in aliases]
    table = F.create_map(*[x for key, path, kind in known for x in (F.lit(key), F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind")))])
    key = spaced_key(label)
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", profile, key)), F.try_element_at(table, F.concat(F.lit("|"), key)))


def normal_value(value: Column, kind: Column) -> Column:
    """Quantities with canonical numbers and units, interfaces by their names; what isn't understood stays as it is."""
    q = quantity(value)
    amount = F.concat(F.concat_ws("..", q["low"], q["high"]), F.lit(" "), q["unit"])
    named = F.nullif(F.array_join(interfaces(value), ","), F.lit(""))
    return F.coalesce(F.when(kind == "interface", named).when(~kind.isin(*UNTYPED), amount), value)


def normalized(raw: DataFrame) -> DataFrame:
    """(…, label, value, profile) with path and normalized value; unmapped values stay as they are."""
    out = raw.withColumn("_d", definition(F.col("label"), F.col("profile")))
    return out.withColumn("path", F.coalesce("_d.path", F.lit("unmapped"))).withColumn("normalized", normal_value(F.col("value"), F.coalesce("_d.kind", F.lit("text")))).drop("_d")


def branches(known: DataFrame) -> DataFrame:
    parts = F.split("path", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return known.where(F.size(parts) > 1).select(F.explode(prefixes).alias("branch")).distinct()
