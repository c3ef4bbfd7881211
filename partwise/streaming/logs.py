"""Structured Streaming over event logs: latest state, throttling, exactly-once append.

The catalogue's queues deliver at least once; state and sinks here are keyed by
deterministic ids, so that a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partwise.operators.lifecycle import throttle_step


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def latest_state(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Running latest row per key (update or complete mode)."""
    best = events.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("m"))
    return best.select(key, F.col(f"m.{order}").alias(order), *[F.col(f"m.{c}").alias(c) for c in columns])


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per tumbling window and type, with a watermark for late rows (an addition to the catalogue's own queries)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


STATE = "since long, n long, until long, blocks long"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else (None, 0, None, 0)
    for t in sorted(int(x) for frame in frames for x in frame["seconds"]):  # one micro-batch's rows of a key, as numbers
        now = throttle_step(now, t)
    state.update(now)
    since, n, until, blocks = now
    yield pd.DataFrame({"key": [key[0]], "since": [since], "n": [n], "until": pd.array([until], dtype="Int64"), "blocks": [blocks]})


def throttle_states(failures: DataFrame, key: str, time: str) -> DataFrame:
    """Throttle state per key, carried from batch to batch; rows of a batch are folded in time order."""
    rows = failures.select(F.col(key).cast("long").alias("key"), F.unix_seconds(F.col(time).cast("timestamp")).alias("seconds"))
    return rows.groupBy("key").applyInPandasWithState(_fold, f"key long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def append_once(spark: SparkSession, path: str, key: str, schema: str):
    """A ``foreachBatch`` sink that appends only rows with new keys: replays add nothing."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            fresh = fresh.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
