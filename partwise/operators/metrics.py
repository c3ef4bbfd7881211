"""Reviewer-labelled metrics: exclusion cascade, confusion counts, rates with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 97.5 % quantile of the normal distribution; the label for no match.
Z = 1.959963984540054
NO_MATCH = "no_match"


def per_mille(x: Column) -> Column:
    return F.bround(x * 1000).cast("long")


def rate(hits: Column, total: Column) -> dict[str, Column]:
    """Share and its 95 % Wilson interval in per mille, rounded half to even; null for no samples."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = hits / n
    wide = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / wide
    margin = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / wide
    bound = lambda x: F.when(n.isNotNull(), per_mille(x))  # noqa: E731  greatest and least skip nulls
    return {"estimate": per_mille(p), "lower": bound(F.greatest(F.lit(0.0), centre - margin)), "upper": bound(F.least(F.lit(1.0), centre + margin))}


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [
        F.count_if(predicted & actual).alias("true_positive"),
        F.count_if(predicted & ~actual).alias("false_positive"),
        F.count_if(~predicted & actual).alias("false_negative"),
        F.count_if(~predicted & ~actual).alias("true_negative"),
    ]


def exclusion() -> Column:
    """The first reason that keeps a candidate out of the sample, null if none.

    Columns: review_state, lifecycle, last_decision (accepted, rejected or null).
    """
    checks = [
        (~F.col("review_state").eqNullSafe("confirmed"), "pending_or_missing_confirmation"),
        (F.col("lifecycle") == "stale", "stale"),
        (F.col("lifecycle") == "conflict", "conflict"),
        (~F.col("lifecycle").isin("accepted", "rejected"), "unresolved"),
        (F.col("last_decision").isNull(), "unreviewed"),
        (F.col("last_decision") != F.col("lifecycle"), "lifecycle_mismatch"),
    ]
    return F.coalesce(*[F.when(c, F.lit(reason)) for c, reason in checks])


def labelled(candidates: DataFrame) -> DataFrame:
    """Candidates with ``excluded`` and, for samples, predicted and actual label."""
    predicted = F.when(F.col("matcher_decision") == "rejected", NO_MATCH).otherwise(F.col("initial_relation"))
    actual = F.when(F.col("lifecycle") == "accepted", F.col("final_relation")).otherwise(NO_MATCH)
    return candidates.withColumns({"excluded": exclusion(), "predicted": predicted, "actual": actual})


def report(samples: DataFrame, by: list[str], positive: str | None = None) -> DataFrame:
    """Confusion counts with precision, recall and accuracy per group."""
    if positive is None:
        p, a = F.col("predicted") != NO_MATCH, F.col("actual") != NO_MATCH
    else:
        p, a = F.col("predicted") == positive, F.col("actual") == positive
    out = samples.groupBy(*by).agg(F.count("*").alias("n"), *confusion(p, a))
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    for name, hits, total in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("accuracy", tp + tn, F.col("n"))):
        for part, value in rate(hits, total).items():
            out = out.withColumn(name if part == "estimate" else f"{name}_{part}", value)
    return out
