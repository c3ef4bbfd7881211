"""Folds keep one state at a time: skewed keys, states across Arrow batches, the seven review actions."""

import random

import pytest
from pyspark.sql import functions as F

from partwise.operators import lifecycle
from partwise.plans import catalogue  # noqa: F401
from partwise.plans import lifecycle as plans


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_key_with_a_third_of_all_rows(spark, small_batches):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 2, 3, None, 4]), rng.randint(0, 40_000)) for _ in range(6000)] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, s long").repartition(5)
    out = lifecycle.throttled(df, "k", F.col("s"))
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "FlatMapGroups" not in plan
    want = {}
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        want[k] = lifecycle.throttle_step(want.get(k, (None, 0, None, 0)), t)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want
    assert lifecycle.throttled(df.limit(0), "k", F.col("s")).count() == 0


def test_memory_of_a_hot_key_stays_flat(spark):
    """The state of a task does not grow with the rows of its key."""
    import resource

    def used() -> int:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    def step(state, row):
        n, early = state
        return n + 1, used() if n == 50_000 else early

    df = spark.range(600_000).select(F.lit(1).alias("k"), "id")
    (row,) = lifecycle.folded(df, "k", ["id"], lambda k: (0, 0), step, lambda state: (state[0], used() - state[1]), "n long, grown_kb long").collect()
    assert row.n == 600_000 and row.grown_kb < 40_000


def test_every_refusal_of_a_review(spark):
    def start():
        return lifecycle.Review({"e0": ["suggested", "r0", "x"], "e1": ["suggested", "r1", "x"], "e2": ["stale", "r2", "y"]}, ["i0", "i1"], ["s0"], {"p1"}, identity="i0")

    def run(*actions):
        state = start()
        return [state.take(*a).code for a in actions], state.row()

    take, drop, relate, identify, spec, issue, confirm = lifecycle.ACTIONS
    codes, row = run(
        (take, "e0", None, 5), (take, "e9", None, None), (take, "e2", None, 1), (relate, "e0", "r0", None), (relate, "e0", "r1", None), (relate, "e2", "r1", None), (identify, "i0", None, None), (identify, "i7", None, None),
        (spec, "s0", "p9", None), (spec, "s9", "p1", None), (confirm, None, None, None),
    )
    assert codes == [
        "import_review_revision_conflict", "enrichment_not_found", "stale_enrichment_review_forbidden", "enrichment_relation_unchanged", "enrichment_relation_conflict", "stale_enrichment_review_forbidden", "identity_candidate_already_selected",
        "identity_candidate_not_found", "specification_taxonomy_path_unknown", "unmapped_specification_not_found", "draft_enrichments_unresolved",
    ]
    assert row[0] == 1 and row[7] == 11
    state = start()
    del state.enrichments["e2"]
    done = [(take, "e0", None, 1), (relate, "e0", "r5", 2), (drop, "e0", None, 3), (take, "e1", None, None), (identify, "i1", None, None), (issue, "c1", "note", None), (confirm, None, None, None), (spec, "s0", "p1", None), (confirm, None, None, 8), (issue, "c2", None, None)]
    assert [state.take(*a).code for a in done] == ["ok"] * 6 + ["draft_specifications_unmapped", "ok", "ok", "import_review_already_confirmed"]
    assert state.row() == (9, "confirmed", "e0=rejected,e1=accepted", "e0=r5,e1=r1", "i1", "s0=p1", "c1", 2, "import_review_already_confirmed")


def test_review_query_reaches_every_outcome(spark):
    actions = plans.review_actions(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    rows = lifecycle.reviewed(actions, "user_id", ["event_id"], plans.review_start).collect()
    assert {r.status for r in rows} == {"pending", "confirmed"}
    assert any(r.mapped == "" or "s1" in r.mapped for r in rows) and all(r.revision + r.n_refused > 1 for r in rows)
