"""Inheritance over parent pointers: every node takes each field from the nearest of itself and its ancestors that has it.

Pointers are jumped: in every round a node takes over what its pointer's target
has found so far and then points where that one points, so a chain of ``n`` is
walked in ``log2 n`` joins. Nodes on a chain that ends come to rest one after
another; when a round brings none to rest, what still moves leads into a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.operators.tables import stored


def inherited(nodes: DataFrame, keys: list[str], parent: str, fields: list[str]) -> DataFrame:
    """``nodes`` (unique on ``keys``) with inherited ``fields``, and ``depth``, ``ancestor`` and ``inherits``.

    ``keys[-1]`` is what ``parent`` names, the other keys are the scope. ``inherits`` is ``none``, ``ok``, ``missing_parent`` (the
    chain ends at a name that isn't there; what the others have is taken) or ``cycle`` (the chain never ends; own fields
    only, depth and ancestor null). ``ancestor`` is the last node of the chain that exists. Null fields are what can be inherited.
    """
    scope, name = keys[:-1], keys[-1]
    own = nodes.select(*keys, F.col(parent).alias("up"), F.lit(0).cast("long").alias("depth"), F.col(name).alias("ancestor"), F.lit(False).alias("missing"), *fields)
    state, moving = stored(own, "inherit"), -1
    while True:
        now = state.where("up IS NOT NULL").count()
        if now in (0, moving):
            break
        moving = now
        above = state.select(*scope, F.col(name).alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("ancestor").alias("_ancestor"), F.col("missing").alias("_missing"), *[F.col(f).alias(f"_{f}") for f in fields])
        met = state.join(above, [*scope, "up"], "left")
        found, lost = F.col("_depth").isNotNull(), F.col("up").isNotNull() & F.col("_depth").isNull()
        state = stored(
            met.select(
                *keys, F.when(found, F.col("_up")).alias("up"), F.when(found, F.col("depth") + F.col("_depth") + 1).otherwise(F.col("depth")).alias("depth"), F.when(found, F.col("_ancestor")).otherwise(F.col("ancestor")).alias("ancestor"),
                (F.col("missing") | F.coalesce("_missing", F.lit(False)) | lost).alias("missing"), *[F.coalesce(f, f"_{f}").alias(f) for f in fields],
            ),
            "inherit",
        )
    ends = F.col("up").isNull()
    told = F.when(~ends, "cycle").when(F.col("missing"), "missing_parent").when(F.col("depth") > 0, "ok").otherwise("none")
    result = state.select(*keys, F.when(ends, F.col("depth")).alias("depth"), F.when(ends, F.col("ancestor")).alias("ancestor"), told.alias("inherits"), *[F.when(ends, F.col(f)).alias(f"_{f}") for f in fields])
    kept = [c for c in nodes.columns if c not in (*keys, *fields)]
    return nodes.join(result, keys).select(*keys, *kept, *[F.coalesce(f"_{f}", f).alias(f) for f in fields], "depth", "ancestor", "inherits")
