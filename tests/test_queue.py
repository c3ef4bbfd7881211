"""The queue's stream gives the batch answer, whatever the order and repetition of its events."""

import random

import pytest
from pyspark.sql import functions as F

from partwise.streaming import queue


def jobs(n=25, seed=3):
    rng, rows, event = random.Random(seed), [], 0
    for job in range(n):
        t = 1_700_000_000_000 + rng.randint(0, 400_000)
        for kind in ["submit"] + [rng.choice(["start", "start", "heartbeat", "fail", "done"]) for _ in range(rng.randint(0, 9))]:
            rows.append((job, event, kind, t))
            event, t = event + 1, t + rng.choice([500, 4_000, 30_000, 70_000])
    return rows


def plain(rows, now):
    out = {}
    for job, _, kind, t in sorted(set(rows), key=lambda r: (r[3], r[1])):
        out[job] = queue.queue_step(out.get(job, queue.NEW), t, kind)
    return {j: queue.due(s, now) for j, s in out.items()}


def test_batch_form_and_every_outcome(spark):
    rows = jobs(200)
    now = min(r[3] for r in rows) + 200_000
    df = spark.createDataFrame(rows + rows[:50], "job long, event_id long, kind string, at long").select("job", "at", "event_id", "kind")
    got = {r.job: (r.status, r.attempts, r.deadline) for r in queue.queue_states(df, "job", now).collect()}
    assert got == plain(rows, now) and {s for s, *_ in got.values()} == {"queued", "running", "retrying", "done", "failed"}


def test_leases_waits_and_attempts():
    run = lambda *events: __import__("functools").reduce(lambda s, e: queue.queue_step(s, *e), events, queue.NEW)
    assert run((0, "submit"), (1, "start"), (59_000, "heartbeat"), (110_000, "done")) == ("done", 1, None)
    assert queue.due(run((0, "submit"), (1, "start")), 60_001) == ("queued", 1, None)
    assert run((0, "submit"), (1, "start"), (10, "fail"), (20, "start")) == ("retrying", 1, 5_010)
    assert run((0, "submit"), (1, "start"), (10, "fail"), (5_010, "start")) == ("running", 2, 65_010)
    assert queue.due(run((0, "submit"), (1, "start"), (61_000, "start"), (200_000, "start")), 260_000) == ("failed", 3, None)


def test_stream_with_replayed_and_late_batches(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(jobs(), key=lambda r: r[3])
        rng, batches = random.Random(1), [rows[i : i + 30] for i in range(0, len(rows), 30)]
        for i in range(1, len(batches)):  # some events come a batch late, some twice
            late = [r for r in batches[i - 1] if rng.random() < 0.2 and batches[i][-1][3] - r[3] < 100_000]
            batches[i - 1] = [r for r in batches[i - 1] if r not in late]
            batches[i] = batches[i] + late + rng.sample(rows[: 30 * i], 10)
        end = max(r[3] for r in rows) + 130_000  # two later jobs drive the watermark on
        batches += [[(900, 9_000, "submit", end)], [(901, 9_001, "submit", end + 1)]]
        for i, batch in enumerate(batches):
            df = spark.createDataFrame(batch, "job long, event_id long, kind string, at long").select("job", "event_id", "kind", F.timestamp_millis("at").alias("time"))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03}")
        stream = spark.readStream.schema("job long, event_id long, kind string, time timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run = queue.queue_stream(stream, "job", "time").writeStream.format("memory").queryName("queue_out").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        run.awaitTermination(240)
        assert run.exception() is None
        got = {r.key: (r.status, r.attempts, r.deadline) for r in spark.table("queue_out").groupBy("key").agg(F.max_by(F.struct("status", "attempts", "deadline"), "revision").alias("s")).select("key", "s.*").collect()}
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    want = plain(rows, end - 120_000)
    assert {k: v for k, v in got.items() if k < 900} == want
