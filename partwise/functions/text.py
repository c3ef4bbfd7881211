"""Text keys, tokens, trigrams and quantities as column expressions.

The text keys differ on purpose: each has its own class of kept characters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that an index does not keep, and package words without meaning.
INDEX_STOP_WORDS = ["a", "an", "and", "for", "grove", "module", "of", "the", "with"]
PACKAGE_STOP_WORDS = ["filter", "footprint", "package"]


@F.pandas_udf(StringType())
def search_key(values: pd.Series) -> pd.Series:
    """NFKC, strip, casefold: the exact form of the search key."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v).strip().casefold(), na_action="ignore")


def folded(c: Column) -> Column:
    """Case folding with built-ins; equal to ``search_key`` on text without compatibility characters."""
    return F.replace(F.lower(F.trim(c)), F.lit("ß"), F.lit("ss"))


def identity_key(c: Column) -> Column:
    """Letters and digits only; empty is null."""
    return F.nullif(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def words_key(c: Column) -> Column:
    """Words joined by one blank; null is empty."""
    return F.coalesce(F.array_join(F.regexp_extract_all(folded(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " "), F.lit(""))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def spaced_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def code_suffix(c: Column) -> Column:
    """Machine code: underscores for runs of others, 80 characters at most, ``unknown`` if empty."""
    code = F.substring(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), 1, 80)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown"))


def clean_inline(c: Column) -> Column:
    """Images and tags go, links keep their text, emphasis marks go, space collapses."""
    for pattern, new in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "), (r"[*_`]+", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def index_tokens(c: Column) -> Column:
    """Distinct tokens of two characters or more without stop words, first occurrence first."""
    tokens = F.array_distinct(F.split(spaced_key(c), " "))
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(INDEX_STOP_WORDS))


def identifier_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+(?:[-_./][a-z0-9]+)*)"), F.lit(1))
    return F.array_distinct(F.transform(found, compact_key))


def package_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(PACKAGE_STOP_WORDS)))


def datasheet_tokens(url: Column) -> Column:
    """Tokens of a URL's path with a digit and four characters or more."""
    path = F.lower(F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1))
    found = F.regexp_extract_all(path, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 4) & t.rlike("[0-9]") & (t != "ds002")))


def trigram_sequence(c: Column) -> Column:
    """Trigrams in order: per word, two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.flatten(each)


def trigrams(c: Column) -> Column:
    """Distinct trigrams."""
    return F.array_distinct(trigram_sequence(c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)), F.lit(0.0))


def bounded(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def canonical_number(c: Column) -> Column:
    """No plus sign, no trailing zeros, no negative zero."""
    c = F.regexp_replace(F.trim(c), r"^\+", "")
    c = F.when(F.contains(c, F.lit(".")), F.regexp_replace(F.regexp_replace(c, "0+$", ""), r"\.$", "")).otherwise(c)
    return F.when(c.isin("-0", ""), F.lit("0")).otherwise(c)


INTERFACES = [
    ("i2c", r"\b(i2c|iic|twi)\b"), ("spi", r"\bspi\b"), ("uart", r"\b(uart|serial)\b"), ("can", r"\bcan( bus)?\b"), ("usb", r"\busb\b"), ("analog", r"\banalog\b"),
    ("digital", r"\bdigital\b"), ("wifi", r"\bwi[ -]?fi\b"), ("bluetooth", r"\bbluetooth\b"),
]


def interfaces(c: Column) -> Column:
    """Canonical interface names that a text mentions."""
    c = F.lower(c)
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in INTERFACES]))


def quantity(c: Column) -> Column:
    """struct(kind, low, high, unit): a range, a tolerance or a scalar with its canonical unit."""
    c = F.lower(F.trim(c))
    number, unit = r"([+-]?[0-9]+(?:\.[0-9]+)?)", r"\s*([a-zµ%°]+)"
    units = F.create_map(*[F.lit(x) for pair in UNITS for x in pair])
    forms = [("range", f"^{number}\\s*(?:to|-|~)\\s*{number}{unit}$", 3), ("tolerance", f"^{number}\\s*(?:±|\\+/-)\\s*{number}{unit}$", 3), ("scalar", f"^{number}{unit}$", 2)]
    out = None
    for kind, pattern, last in forms:
        low = canonical_number(F.regexp_extract(c, pattern, 1))
        high = canonical_number(F.regexp_extract(c, pattern, 2)) if last == 3 else F.lit(None).cast("string")
        name = F.regexp_extract(c, pattern, last)
        one = F.when(c.rlike(pattern), F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), F.coalesce(units[name], name).alias("unit")))
        out = one if out is None else F.coalesce(out, one)
    return out


# Unit words and their symbols.
UNITS = [("volt", "V"), ("volts", "V"), ("v", "V"), ("millivolts", "mV"), ("mv", "mV"), ("amp", "A"), ("amps", "A"), ("a", "A"), ("ma", "mA"), ("watt", "W"), ("watts", "W"), ("w", "W"), ("ohm", "Ω"), ("ohms", "Ω"), ("hz", "Hz"), ("khz", "kHz"), ("mhz", "MHz"), ("mm", "mm"), ("cm", "cm"), ("g", "g"), ("grams", "g"), ("kg", "kg"), ("ms", "ms"), ("s", "s")]


def canonical_text(value: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip()
