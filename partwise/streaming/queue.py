"""A durable job queue as a stream: leases that expire, retries that wait, attempts that run out.

Events of a job (submit, start, heartbeat, done, fail) come at least once and in any order
within ``DELAY`` of each other. A job's state is what its events say in the order of their times, with
leases and waits ending by the clock of the watermark; so replayed and late batches lead to the state
that one sorted pass over all events gives (``queue_states``, the batch form). Events behind the
watermark are settled and replays of them are ignored; a job keeps only the events after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from partwise.operators.lifecycle import folded

LEASE, ATTEMPTS = 60_000, 3
DELAY = "2 minutes"
STATE = "status string, attempts long, deadline long"
NEW = (None, 0, None)


def wait_ms(attempt: int) -> int:
    return min(60_000, 5_000 * 2 ** max(0, attempt - 1))


def due(state: tuple, now: int) -> tuple:
    """The state at ``now`` (milliseconds): a lease that ended gives the job back or, after the last attempt, up; a wait that ended queues it."""
    status, attempts, deadline = state
    if deadline is None or deadline > now:
        return state
    return ("failed" if status == "running" and attempts >= ATTEMPTS else "queued", attempts, None)


def queue_step(state: tuple, at: int, kind: str) -> tuple:
    """One event; events that do not fit the state change nothing."""
    status, attempts, deadline = due(state, at)
    if kind == "submit" and status is None:
        return "queued", 0, None
    if kind == "start" and status == "queued":
        return ("failed", attempts, None) if attempts >= ATTEMPTS else ("running", attempts + 1, at + LEASE)
    if status == "running" and kind == "heartbeat":
        return "running", attempts, at + LEASE
    if status == "running" and kind == "done":
        return "done", attempts, None
    if status == "running" and kind == "fail":
        return ("failed", attempts, None) if attempts >= ATTEMPTS else ("retrying", attempts, at + wait_ms(attempts))
    return status, attempts, deadline


def queue_states(events: DataFrame, key: str, now: int) -> DataFrame:
    """The batch form: states at ``now`` of (key, at, event_id, kind), ``at`` in milliseconds; repeated events count once."""
    return folded(events.dropDuplicates([key, "event_id"]), key, ["at", "event_id"], lambda k: NEW, lambda s, r: queue_step(s, r[0], r[2]), lambda s: due(s, now), STATE)


class _Queue(StatefulProcessor):
    """``settled``: the state up to the watermark that a job last saw; ``pending``: its events after that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._settled = handle.getValueState("settled", f"{STATE}, upto long, revision long, shown string")
        self._pending = handle.getMapState("pending", "event_id long", "at long, kind string")

    def _settle(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        kept = self._settled.get() if self._settled.exists() else (*NEW, -1, 0, "")
        state, upto, revision, shown = tuple(kept[:3]), kept[3], kept[4], kept[5]
        later = sorted((v[0], k[0], v[1]) for k, v in self._pending.iterator())
        for at, event, kind in [e for e in later if e[0] <= now]:
            state = queue_step(state, at, kind)
            self._pending.removeKey((event,))
        state = due(state, now)
        view = state
        for at, _, kind in (e for e in later if e[0] > now):
            view = queue_step(view, at, kind)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        ends = [t for t in (view[2], state[2], *(e[0] for e in later if e[0] > now)) if t is not None and t > now]
        if ends:
            self._handle.registerTimer(min(ends))
        changed = repr(view) != shown
        self._settled.update((*state, max(now, upto), revision + changed, repr(view)))
        if changed:
            status, attempts, deadline = view
            yield pd.DataFrame({"key": [key[0]], "revision": [revision + 1], "status": [status], "attempts": [attempts], "deadline": pd.array([deadline], dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        upto = self._settled.get()[3] if self._settled.exists() else -1
        for frame in rows:
            for event, at, kind in zip(frame["event_id"], frame["at"], frame["kind"]):
                if at > upto:
                    self._pending.updateValue((int(event),), (int(at), str(kind)))
        yield from self._settle(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, revision, status, attempts, deadline): every change of a job's state, from a stream of (key, event_id, kind, time).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.withWatermark(time, DELAY).select(F.col(key).cast("long").alias("key"), "event_id", "kind", time, F.unix_millis(time).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(_Queue(), f"key long, revision long, {STATE}", "Update", "EventTime")
