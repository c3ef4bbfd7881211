from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from partwise.llm import neardup
from partwise.llm.common import read, stored

from helpers import awkward, words
from test_decontam import brute as hits
from test_neardup import brute as groups
from test_tokens import expected

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_plain_versions(spark):
    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "token_ids":
            assert docs.columns == columns
    languages = pairs(seen["language_id"])
    assert Counter(languages) == Counter((i, t) for i, t in pairs(seen["documents"]) if t and any(map(str.isalpha, t)))
    want = {g[0] for g in groups(languages) if g[3]}
    unique = pairs(seen["near_duplicates"])
    assert {i for i, _ in unique} == want and len(unique) == len(want)
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    clean = {h[0] for h in hits(unique, items) if not h[2]}
    assert {i for i, _ in pairs(seen["decontaminate"])} == clean
    mixed = pairs(seen["mix_sources"])
    assert {i for i, _ in mixed} <= clean and max(Counter(i for i, _ in mixed).values()) <= 2
    assert sorted(map(tuple, docs.collect()), key=repr) == expected(mixed)


def test_stages_take_awkward_rows_and_columns(spark):
    clashing = ["a.b", "`q`", "_found_x", "_found_items", "_lang_pred", "_lang_score", "_leaving", "_mix_size", "row", "id", "again", "_copy"]
    docs = awkward(spark).select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in clashing])
    columns, seen = docs.columns, [Counter(map(tuple, docs.collect()))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = stored(docs, name)
        seen.append(Counter(map(tuple, docs.collect())))
        assert set(seen[-1]) <= set(seen[-2]), name
    language, unique, clean, mixed = seen[1:]
    texts = [(r[0], r[1]) for r in language.elements()]
    assert Counter((r[0], r[1]) for r in unique.elements()) == Counter(kept(texts))
    assert clean == unique and all(n <= 2 for n in mixed.values())
    assert sorted(map(tuple, corpus_pipeline.token_ids(spark, docs, SF).collect()), key=repr) == expected([(r[0], r[1]) for r in mixed.elements()])
    assert neardup.deduplicated(docs.limit(0)).count() == 0


def kept(texts):
    """One text of each group by its own words (the awkward texts are equal or far apart); all without id or words."""
    out, groups = [], set()
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        w = tuple(words(t))
        if i is None or not w or w not in groups:
            out.append((i, t))
        if i is not None:
            groups.add(w)
    return out
