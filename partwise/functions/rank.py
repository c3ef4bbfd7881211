"""Full-text matching and ranking as column expressions.

A document is an array of (token, position, weight letter); a query is an
array of distinct tokens. The rank follows cover density: every minimal
stretch of positions that holds all query tokens adds the harmonic mean of its
weights, divided by one plus the gap of other positions in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from partwise.functions.text import trigrams

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def weighted_tokens(parts: list[tuple[Column, str]]) -> Column:
    """Tokens of the parts in order, each with its weight; positions run on over the parts."""
    arrays = [F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), _weigh(weight)) for text, weight in _bound(parts)]
    return F.transform(F.concat(*arrays), lambda x, i: F.struct(x["t"].alias("t"), i.alias("pos"), x["w"].alias("w")))


def _weigh(weight: float):
    return lambda t: F.struct(t.alias("t"), F.lit(weight).alias("w"))


def _bound(parts: list[tuple[Column, str]]) -> list[tuple[Column, float]]:
    return [(F.coalesce(text, F.lit("")), WEIGHTS[letter]) for text, letter in parts]


def matches_all(tokens: Column, query: list[str]) -> Column:
    have = F.transform(tokens, lambda x: x["t"])
    return F.size(F.array_except(F.array(*[F.lit(q) for q in query]), have)) == 0


def cover_rank(tokens: Column, query: list[str]) -> Column:
    """Sum over the query's occurrences of the weight of the nearest cover that ends there.

    For each occurrence of any query token, the latest position of every other
    token before it gives the cover that ends there; it counts if it starts
    later than the cover before (is minimal).
    """
    hits = F.filter(tokens, lambda x: x["t"].isin(query))
    if len(query) == 1:
        return F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["w"])
    start = F.struct(
        *[F.lit(-1).alias(f"p{i}") for i in range(len(query))], *[F.lit(0.0).alias(f"w{i}") for i in range(len(query))], F.lit(-1).alias("last"), F.lit(0.0).alias("sum")
    )

    def step(acc: Column, x: Column) -> Column:
        pos = [F.when(x["t"] == q, x["pos"]).otherwise(acc[f"p{i}"]) for i, q in enumerate(query)]
        wgt = [F.when(x["t"] == q, x["w"]).otherwise(acc[f"w{i}"]) for i, q in enumerate(query)]
        begin = F.least(*pos)
        inverse = sum((1 / w for w in wgt[1:]), 1 / wgt[0])
        gain = len(query) / inverse / (1 + (x["pos"] - begin - (len(query) - 1)))
        fresh = (begin >= 0) & (begin > acc["last"])
        return F.struct(
            *[p.alias(f"p{i}") for i, p in enumerate(pos)], *[w.alias(f"w{i}") for i, w in enumerate(wgt)],
            F.when(fresh, begin).otherwise(acc["last"]).alias("last"), F.when(fresh, acc["sum"] + gain).otherwise(acc["sum"]).alias("sum"),
        )

    return F.aggregate(hits, start, step, lambda acc: acc["sum"])


def word_share(needle: Column, text: Column) -> Column:
    """Share of the needle's trigrams that the text holds: no word similarity is above it."""
    return F.coalesce(F.size(F.array_intersect(trigrams(needle), trigrams(text))) / F.size(trigrams(needle)), F.lit(0.0))


def best_stretch(own: set[str], sequence: Iterable[str]) -> float:
    """The greatest Jaccard similarity of ``own`` and any stretch of a sequence, in one sweep.

    A best stretch holds its first and its last member once: without a repeated end it has the same members. So for
    each end that is in ``own``, walking back over the distinct members by their latest place meets every start that matters;
    the walk stops where even all of ``own`` could not make up for the members in between.
    """
    latest: dict[str, None] = {}
    best, most = 0.0, len(own)
    if not own:
        return best
    for gram in sequence:
        latest.pop(gram, None)
        latest[gram] = None
        if gram not in own:
            continue
        shared = other = 0
        for x in reversed(latest):
            if x in own:
                shared += 1
                best = max(best, shared / (most + other))
                if shared == most:
                    break
            else:
                other += 1
                if best * (most + other) >= most:
                    break
    return best


def grams_in_order(text: str) -> list[str]:
    """The trigrams of a text as ``trigram_sequence`` has them: of every word, with two blanks before and one after."""
    return [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text.lower()) for i in range(len(w) + 1)]


@F.pandas_udf(DoubleType())
def _best_stretches(needle: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_stretch(set(grams_in_order(a)), grams_in_order(b)) if a and b else 0.0 for a, b in zip(needle, text)], dtype=float)


#: Marked so that no filter on its result moves it into a join's condition, where Python cannot run.
_once_a_row = _best_stretches.asNondeterministic()


def word_similarity(needle: Column, text: Column) -> Column:
    """The greatest Jaccard similarity of the needle's trigrams and any stretch of the text's trigrams; 0 where either has none."""
    return _once_a_row(needle, text)
