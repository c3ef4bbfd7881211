"""State derived from event logs: folds, leases, throttling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WINDOW, LIMIT, BLOCK = 900, 5, 900


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[Any], Any], step: Callable[[Any, tuple], Any], finish: Callable[[Any], tuple], schema: str) -> DataFrame:
    """(key, ``schema``): every key's rows folded in their order, whatever their number.

    Rows are sorted by key and order on disk if need be; a task reads them as a stream and keeps the state of one key,
    across Arrow batches, so that a key with a third of all rows takes no more memory than any other. ``start`` makes the
    state of a key, ``step`` takes it and a row (all columns but the key), ``finish`` gives the result columns.
    A null key is a key of its own; rows that tie in ``order`` must be alike or be told apart by it.
    """
    others = [c for c in rows.columns if c != key]
    sorted_rows = rows.select(key, *others).repartition(key).sortWithinPartitions(key, *order)
    result = StructType([sorted_rows.schema[key], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(result)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, state = False, None, None
        for batch in batches:
            done = []
            keys, *columns = (c.to_pylist() for c in batch.columns)
            for k, *row in zip(keys, *columns):
                if not open_ or k != now:
                    if open_:
                        done.append((now, *finish(state)))
                    open_, now, state = True, k, start(k)
                state = step(state, tuple(row))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, *finish(state)), arrow)], schema=arrow)

    return sorted_rows.mapInArrow(fold, result)


THROTTLE = "since long, n long, until long, blocks long"


def throttle_step(state: tuple, t: int) -> tuple:
    """Fixed window anchored at the first failure: its start, its count, the end of a block, and how often the limit was reached."""
    since, n, until, blocks = state
    if since is None or since + WINDOW <= t:
        since, n, until = t, 0, None
    n += 1
    return (since, n, t + BLOCK, blocks + 1) if n >= LIMIT else (since, n, until, blocks)


def throttled(failures: DataFrame, key: str, seconds: Column) -> DataFrame:
    """Final throttle state per key; failures without a time are left out."""
    rows = failures.select(key, seconds.cast("long").alias("_t")).where("_t IS NOT NULL")
    return folded(rows, key, ["_t"], lambda k: (None, 0, None, 0), lambda state, row: throttle_step(state, row[0]), lambda state: state, THROTTLE)


def throttle_fold(times: Column) -> Column:
    """The same fold over an array of sorted seconds, where a list is known to be short."""
    start = F.struct(F.lit(None).cast("long").alias("since"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("until"), F.lit(0).cast("long").alias("blocks"))

    def step(a: Column, t: Column) -> Column:
        fresh = a["since"].isNull() | (a["since"] + WINDOW <= t)
        n = F.when(fresh, F.lit(1).cast("long")).otherwise(a["n"] + 1)
        return F.struct(
            F.when(fresh, t).otherwise(a["since"]).alias("since"), n.alias("n"),
            F.when(n >= LIMIT, t + BLOCK).when(fresh, F.lit(None).cast("long")).otherwise(a["until"]).alias("until"),
            F.when(n >= LIMIT, a["blocks"] + 1).otherwise(a["blocks"]).alias("blocks"),
        )

    return F.aggregate(times, start, step)


# The actions of a review, in this order, and the codes of those that are refused.
ACTIONS = ["enrichment_accepted", "enrichment_rejected", "enrichment_relation_changed", "identity_selected", "specification_mapped", "parser_issue_marked", "draft_confirmed"]
REVISION, CONFIRMED, NO_ENRICHMENT, STALE = "import_review_revision_conflict", "import_review_already_confirmed", "enrichment_not_found", "stale_enrichment_review_forbidden"
REVIEW = "revision long, status string, enrichments string, relations string, identity string, mapped string, issues string, n_refused long, last_code string"


@dataclass
class Review:
    """The state of one review draft. ``enrichments``: name to (status, relation, identity that it is of)."""

    enrichments: dict[str, list]
    identities: list[str]
    specifications: list[str]
    paths: set[str]
    revision: int = 1
    confirmed: bool = False
    identity: str | None = None
    mapped: dict[str, str] = field(default_factory=dict)
    issues: set[str] = field(default_factory=set)
    refused: int = 0
    code: str = ""

    def take(self, action: str, target: str | None, value: str | None, expected: int | None) -> Review:
        """One action, done or refused; what is done makes a new revision."""
        self.code = self._refusal(action, target, value, expected) or "ok"
        if self.code == "ok":
            self.revision += 1
            self._do(action, target, value)
        else:
            self.refused += 1
        return self

    def _refusal(self, action: str, target: str | None, value: str | None, expected: int | None) -> str | None:
        if expected is not None and expected != self.revision:
            return REVISION
        if self.confirmed:
            return CONFIRMED
        if action in ACTIONS[:3]:
            if target not in self.enrichments:
                return NO_ENRICHMENT
            status, relation, of = self.enrichments[target]
            if status == "stale":
                return STALE
            if action == ACTIONS[2]:
                if relation == value:
                    return "enrichment_relation_unchanged"
                if any(name != target and other[1:] == [value, of] for name, other in self.enrichments.items()):
                    return "enrichment_relation_conflict"
        elif action == "identity_selected":
            return "identity_candidate_not_found" if target not in self.identities else "identity_candidate_already_selected" if target == self.identity else None
        elif action == "specification_mapped":
            return "specification_taxonomy_path_unknown" if value not in self.paths else "unmapped_specification_not_found" if target not in self.specifications else None
        elif action == "draft_confirmed":
            if any(status in ("suggested", "stale", "conflict") for status, *_ in self.enrichments.values()):
                return "draft_enrichments_unresolved"
            return None if set(self.specifications) <= set(self.mapped) else "draft_specifications_unmapped"
        return None

    def _do(self, action: str, target: str | None, value: str | None) -> None:
        if action in ACTIONS[:2]:
            self.enrichments[target][0] = "accepted" if action == ACTIONS[0] else "rejected"
        elif action == ACTIONS[2]:
            self.enrichments[target][:2] = ["suggested", value]
        elif action == "identity_selected":
            self.identity = target
        elif action == "specification_mapped":
            self.mapped[target] = value
        elif action == "parser_issue_marked":
            self.issues.add(target)
        else:
            self.confirmed = True

    def row(self) -> tuple:
        listed = lambda i: ",".join(f"{k}={v[i]}" for k, v in sorted(self.enrichments.items()))
        mapped = ",".join(f"{k}={v}" for k, v in sorted(self.mapped.items()))
        return self.revision, "confirmed" if self.confirmed else "pending", listed(0), listed(1), self.identity, mapped, ",".join(sorted(self.issues)), self.refused, self.code


def reviewed(actions: DataFrame, key: str, order: list[str], start: Callable[[Any], Review]) -> DataFrame:
    """State of every draft after all its actions; ``actions``: key, order, action, target, value, expected (a revision, or null for the current one)."""
    at = [c for c in actions.columns if c != key]
    a, t, v, e = (at.index(c) for c in ("action", "target", "value", "expected"))
    return folded(actions, key, order, start, lambda state, row: state.take(row[a], row[t], row[v], row[e]), lambda state: state.row(), REVIEW)


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(60000.0), 5000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))).cast("long")


def latest(log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Latest state per key of an append-only log, in one aggregation."""
    return log.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in columns])
