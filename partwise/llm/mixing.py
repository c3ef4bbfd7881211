"""Mixing sources to target weights (Efraimidis-Spirakis sampling).

Every document gets the exponential key ``-ln(u) / w`` with ``u`` from a hash
of its id and text and ``w`` its quality weight. A source whose target is
``t`` words repeats whole epochs first (``floor(t / size)``) and takes the rest
in key order until the running word count is nearest to what is left.

The running count needs no sort of a source: word counts between quantiles of
its keys show where the target is crossed, that piece is cut again in the same
way, and only the last one's few documents are ordered. What remains is one
cut-off per source, applied to all rows as an expression.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; quality weights that are null or not above 0 count as 1; ties between
keys go to the smaller id; where the cut falls among rows equal in source, id and
text, as many of them are taken as come nearest to the target (by partition and
place, so that no task orders the whole group); sources without words get target
0; texts are only hashed and counted by Spark's own expressions, whatever their
length; an empty table gives an empty result. Other columns are handed
through by position, so no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, row_of, rows_again, stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, quality: Column, seed: int) -> DataFrame:
    """Source, id, size, sampling key and tie-breaking hash of every row, and the row itself.

    ``u`` is drawn from the MD5 of seed, id and text, which every engine has.
    """
    read = F.coalesce(F.col(text).cast("string"), F.lit("\0"))
    drawn = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")), read).cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(2**48))
    w = F.when(quality > 0, quality).otherwise(F.lit(1.0))
    return docs.select(
        F.col(source).alias("_mix_source"), F.col(doc_id).alias("_mix_id"), n_words(F.col(text)).alias("_mix_size"), drawn.alias("_mix_tie"),
        (-F.log(u) / w).alias("_mix_key"), row_of(docs).alias("row"),
    )


KEYS = ["_mix_source", "_mix_id", "_mix_size", "_mix_tie", "_mix_key"]
#: Key ranges that a round of the search for the cut-off tells apart, and rows that are ordered at last.
RANGES, LAST = 64, 4096


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: its words and its target, the excess over ``cap`` sizes reshared by weight.

    Works on one row per source; the level ``v`` with sum(min(cap * size, v * weight))
    = share * total is read off the sources in the order of cap * size / weight.
    """
    by_source = sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last()))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = by_source.withColumn("_rank", rank).withColumn("_w", F.element_at(w, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy("_full_at", "_rank")
    everything = Window.orderBy("_full_at", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_cap", F.lit(cap) * F.col("source_size"))
        .withColumn("_full_at", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_after", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.lit(share) * F.col("_total") - F.col("_before")) / F.col("_after"))
        .withColumn("_capped", F.col("_full_at") <= F.col("_level"))
        .withColumn("_final", F.first(F.when(~F.col("_capped"), F.col("_level")), ignorenulls=True).over(everything))
    )
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return levels.select("_mix_source", "source_size", target.cast("double").alias("target"))


def _crossing(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the key range [low, high] in which its rest is crossed, its rows, and the words below it.

    Every round cuts each source's range at quantiles of its own keys, whatever
    weights they have, and keeps the piece with the crossing, until no piece
    has more than ``LAST`` rows or it is a single key. Rows of one key lie together.
    """
    begin = plan.where("_rest > 0").select("_mix_source", "_rest", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("below"), F.lit(2**62).alias("rows"))
    done, open_ = None, stored(begin, "mix-ranges")
    while not open_.isEmpty():
        inside = lookup(sized.select("_mix_source", "_mix_key", "_mix_size", "_mix_tie"), open_, ["_mix_source"], F.col("_mix_tie"))
        inside = inside.where((F.col("_mix_key") >= F.col("low")) & (F.col("_mix_key") <= F.col("high")))
        share = [(i + 1) / RANGES for i in range(RANGES - 1)]
        cuts = inside.groupBy("_mix_source").agg(F.percentile_approx("_mix_key", share, 20 * RANGES).alias("cuts"), F.max("_mix_key").alias("most"))
        cuts = stored(cuts.select("_mix_source", F.array_distinct(F.concat("cuts", F.array("most"))).alias("cuts")), "mix-cuts")
        # The piece of a key: the first cut that isn't below it.
        placed = lookup(inside, cuts, ["_mix_source"], F.col("_mix_tie"))
        piece = F.aggregate("cuts", F.lit(0), lambda n, c: n + (c < F.col("_mix_key")).cast("int"))
        along = Window.partitionBy("_mix_source").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
        pieces = placed.withColumn("piece", piece).groupBy("_mix_source", "piece").agg(
            F.sum("_mix_size").alias("words"), F.count("*").alias("n"), F.min("_mix_key").alias("least"), F.max("_mix_key").alias("most"), *[F.first(c).alias(c) for c in ("_rest", "below")]
        )
        upto = pieces.withColumn("upto", F.col("below") + F.sum("words").over(along))
        crossed = upto.where((F.col("upto") >= F.col("_rest")) & (F.col("upto") - F.col("words") < F.col("_rest")))
        found = stored(crossed.select("_mix_source", "_rest", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("upto") - F.col("words")).alias("below"), F.col("n").alias("rows")), "mix-ranges")
        closed = found.where((F.col("rows") <= LAST) | (F.col("high") == F.col("low")))
        done = closed if done is None else done.unionByName(closed)
        open_ = found.where((F.col("rows") > LAST) & (F.col("high") > F.col("low")))
    return done if done is not None else begin.limit(0)


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: size, target, whole epochs, and the cut-off of the last, partial epoch (key, id, tie)."""
    plan = stored(
        targets(sized, weights, share, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "mix-targets",
    )
    crossing = stored(_crossing(sized, plan), "mix-crossing")
    inside = lookup(sized.select(*KEYS), crossing, ["_mix_source"], F.col("_mix_tie"))
    inside = inside.where((F.col("_mix_key") >= F.col("low")) & (F.col("_mix_key") <= F.col("high")))
    # Rows of one key, id and tie are equal; they are one step, of which the nearest number is taken.
    steps = inside.groupBy("_mix_source", "_mix_key", "_mix_id", "_mix_tie").agg(F.sum("_mix_size").alias("words"), F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("_rest", "below")])
    by_key = Window.partitionBy("_mix_source").orderBy("_mix_key", "_mix_id", "_mix_tie").rowsBetween(Window.unboundedPreceding, 0)
    each, before = F.col("words") / F.col("_n"), F.col("below") + F.sum("words").over(by_key) - F.col("words")
    some = F.when(each > 0, F.greatest(F.lit(0), F.least(F.col("_n"), F.ceil((F.col("_rest") - F.col("_before")) / each - 0.5)))).otherwise(F.col("_n")).cast("long")
    at = steps.withColumn("_before", before).withColumn("_some", some).withColumn("_at", (F.col("_before") + F.col("_some") * each).cast("long")).withColumn("_off", F.abs(F.col("_at") - F.col("_rest")))
    cut = at.groupBy("_mix_source").agg(
        F.min(F.struct("_off", "_at", F.struct("_mix_key", "_mix_id", "_mix_tie").alias("cut"), "_some", "_n")).alias("_best"), F.first(F.abs(F.col("below") - F.col("_rest"))).alias("_off_below"), F.min("_mix_key").alias("_least")
    )
    # Nearer without any step: everything below the range.
    before = F.struct(F.col("_least").alias("_mix_key"), F.lit(None).cast(sized.schema["_mix_id"].dataType).alias("_mix_id"), F.lit("").alias("_mix_tie"))
    better = F.col("_best._off") < F.col("_off_below")
    cut = cut.select("_mix_source", F.when(better, F.col("_best.cut")).otherwise(before).alias("cut"), F.when(better, F.col("_best._some")).alias("_some"), F.when(better, F.col("_best._n")).alias("_n"))
    return stored(lookup(plan, cut, ["_mix_source"], F.col("source_size")), "mix-plan")


def with_mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``sized`` with their source's size and target, ``copies`` and ``taken`` words."""
    where = F.struct("_mix_key", "_mix_id", "_mix_tie")
    out = lookup(sized, plan, ["_mix_source"], F.col("_mix_tie")).withColumn("_more", F.coalesce(where <= F.col("cut"), F.lit(False)))
    if not plan.where("_some < _n").isEmpty():  # a cut among equal rows
        parted = F.coalesce(where.eqNullSafe(F.col("cut")) & (F.col("_some") < F.col("_n")), F.lit(False))
        equal = stored(out.where(parted).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "mix-equal")
        ahead = F.sum("n").over(Window.partitionBy("_mix_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        parts = equal.groupBy("_mix_source", "_part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n")  # a row for each partition
        nth = F.row_number().over(Window.partitionBy("_mix_source", "_part").orderBy("_place"))  # no more rows than a partition had
        numbered = lookup(equal.withColumn("_nth", nth), parts, ["_mix_source", "_part"], F.col("_place"))
        numbered = numbered.withColumn("_more", F.col("_nth") + F.col("ahead") <= F.col("_some"))
        out = out.where(~parted).unionByName(numbered.select(*out.columns))
    copies = (F.col("epochs") + F.when(F.col("_more"), 1).otherwise(0)).cast("long")
    return out.withColumn("_mix_copies", copies).withColumn("_mix_taken", F.col("_mix_copies") * F.col("_mix_size"))


def mixed_report(docs: DataFrame, quality: Column, doc_id="doc_id", text="text", source="source", seed: int = 17, **plan) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sized = stored(keyed(docs, doc_id, text, source, quality, seed).select(*KEYS), "mix-sizes")
    out = with_mix(sized, mix_plan(sized, **plan))
    return out.select(F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), "source_size", "target", F.col("_mix_taken").alias("taken"))


def mixed_documents(docs: DataFrame, quality: Column, doc_id="doc_id", text="text", source="source", seed: int = 17, **plan) -> DataFrame:
    """The mix itself: every document once per copy taken, with the columns of ``docs``."""
    rows = keyed(docs, doc_id, text, source, quality, seed)
    sized = stored(rows.select(*KEYS), "mix-sizes")
    out = with_mix(rows, mix_plan(sized, **plan)).where(F.col("_mix_copies") > 0)
    return rows_again(out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))).alias("_copy")), docs)


def text_quality(text: Column) -> Column:
    """Quality weight of a text, 0.1 to 1: the share of its characters that are not digits or ASCII symbols."""
    n = F.char_length(text)
    kept = F.char_length(F.translate(text, "0123456789*#$%&|<>{}[]=_~^@+\\/", ""))
    return F.when(n > 0, F.greatest(F.lit(0.1), kept / n)).otherwise(F.lit(1.0))
