"""Versioned tables against dictionaries; concurrent and faulty changes."""

import random

import pytest

from partwise.operators.versioned import BadBatch, StaleVersion, VersionedTable

ROW = "k long, v string"


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_changes_against_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    batch = lambda n: {rng.randint(0, 99): f"v{rng.randint(0, 999)}" for _ in range(n)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), ROW)
    now = batch(40)
    table = VersionedTable.create(frame(now), f"file://{tmp_path}/t", ["k"], buckets=8)
    states = [dict(now)]
    for change in ("upsert", "insert_ignore", "delete", "upsert"):
        some = batch(15)
        assert getattr(table, change)(frame(some)) == len(states)
        now = {**now, **some} if change == "upsert" else {**some, **now} if change == "insert_ignore" else {k: v for k, v in now.items() if k not in some}
        states.append(dict(now))
    for version, state in enumerate(states):
        assert rows(table, version) == sorted(state.items())
    assert rows(table) == sorted(now.items()) and VersionedTable(spark, table.path).versions() == [0, 1, 2, 3, 4]
    table.compact()
    assert rows(table) == sorted(now.items()) and all(len(f) == 1 for f in table.manifest()["files"].values())
    assert table.forget_before(5) > 0 and table.versions() == [5] and rows(table) == sorted(now.items())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = VersionedTable.create(spark.range(1000).selectExpr("id AS k", "'a' AS v"), f"file://{tmp_path}/t", ["k"], buckets=16)
    table.upsert(spark.createDataFrame([(7, "b")], ROW))
    old, new = (table.manifest(v)["files"] for v in (0, 1))
    assert sum(old[b] != new[b] for b in old) == 1 and len(new) == 16
    table.insert_ignore(spark.createDataFrame([(7, "c"), (5000, "c")], ROW))
    added = table.manifest()["files"]
    assert all(set(new[b]) <= set(added[b]) for b in new) and sum(len(f) for f in added.values()) == 17
    assert dict(rows(table))[7] == "b" and dict(rows(table))[5000] == "c"


def test_stale_versions_and_bad_batches_are_refused(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), ROW)
    table = VersionedTable.create(frame((1, "a"), (2, "b")), f"file://{tmp_path}/t", ["k"], buckets=4)
    other = VersionedTable(spark, table.path)
    assert other.upsert(frame((1, "x")), expected=0) == 1
    with pytest.raises(StaleVersion):
        table.upsert(frame((2, "y")), expected=0)
    # Both saw version 1; the second finds the next one published when it comes to publish its own.
    base, new = table.manifest(1), table._written(frame((2, "z")), table.manifest(1))
    other.upsert(frame((2, "w")))
    with pytest.raises(StaleVersion):
        table._commit(base, 1, "upsert", new, touched=[0, 1, 2, 3])
    assert rows(table) == [(1, "x"), (2, "w")] and table.versions() == [0, 1, 2]
    assert not (tmp_path / "t" / next(iter(new.values()))[0]).exists()
    for bad, code in ((frame((None, "n")), "null_key"), (frame((5, "a"), (5, "b")), "repeated_key")):
        for change in (table.upsert, table.insert_ignore):
            with pytest.raises(BadBatch, match=code):
                change(bad)
    assert rows(table) == [(1, "x"), (2, "w")]


def test_logs_children_and_empty_batches(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), ROW)
    table = VersionedTable.create(frame((1, "a"), (1, "b"), (2, "c")), f"file://{tmp_path}/t", ["k"], buckets=4)
    table.append(frame((1, "a"), (None, "n")))
    assert sorted(map(tuple, table.read().collect()), key=repr) == [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "n")]
    table.replace_children(frame((1, "z"), (3, "y"), (3, "x")))
    assert sorted(map(tuple, table.read().where("k IS NOT NULL").collect())) == [(1, "z"), (2, "c"), (3, "x"), (3, "y")]
    before = table.read().count()
    table.upsert(frame((9, "q")).limit(0))
    assert table.read().count() == before
    empty = VersionedTable.create(frame((1, "a")).limit(0), f"file://{tmp_path}/e", ["k"])
    assert rows(empty) == [] and empty.upsert(frame((1, "a"))) == 1 and rows(empty) == [(1, "a")]
