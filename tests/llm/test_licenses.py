import random
import re

from partwise.llm import licenses
from partwise.llm.common import read
from partwise.llm.licenses import NOTICES, license_matches
from partwise.llm.queries import op9_license_scan

from helpers import awkward, empty

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = [x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows):
    notices = [(name, set(shingles(t))) for name, t in NOTICES]
    return {(i, name) for i, t in rows for name, own in notices if len(own & set(shingles(t))) >= 0.75 * len(own)}


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    got = op9_license_scan(spark, SF).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == brute(rows) and got
    assert all(0.75 <= r["containment"] <= 1 for r in got)


def test_every_notice_anywhere_and_altered(spark):
    rows = []
    for n, (_, text) in enumerate(NOTICES):
        for shift in range(0, 9, 2):
            rows.append((100 * n + shift, " ".join(f"w{k}" for k in range(shift)) + " " + text.upper().replace(" ", "\n") + " and more words follow here"))
        w = text.split()
        if len(w) > 20:
            rows.append((100 * n + 50, " ".join([*w[:10], "changed", *w[11:]])))
    got = {(r["doc_id"], r["license"]) for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_recall_at_every_containment(spark):
    rng = random.Random(3)
    rows = []
    for n, (_, text) in enumerate(NOTICES):
        w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        for k in range(1, 40 if len(w) > 40 else 4):  # up to 0.75 of the shingles are left
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 18))):
                v[rng.randrange(len(v))] = f"x{rng.random()}"[:9].replace(".", "")
            rows.append((1000 * n + k, " ".join([f"y{rng.random()}" for _ in range(rng.randint(0, 40))] + v + ["and", "more"])))
    got = {(r["doc_id"], r["license"]) for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got <= want and len(want) > 300
    assert len(got) >= 0.99 * len(want), (len(got), len(want))


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 50)
    rng = random.Random(4)
    rows = [(i, " ".join([f"w{rng.random()}" for _ in range(rng.randint(0, 700))]) + " " + text + " tail") for i, (_, text) in enumerate(NOTICES)]
    got = {(r["doc_id"], r["license"]) for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_awkward_rows(spark):
    docs = awkward(spark, [(30, "Released under the MIT License.", "en", "a"), (30, "Released under the MIT License.", "en", "a"), (None, "Licensed under CC BY-NC 4.0.", "en", "a")])
    got = sorted(map(tuple, license_matches(docs).collect()), key=repr)
    assert got == sorted([(30, "MIT", 1.0, 0), (None, "CC-BY-NC-4.0", 1.0, 0)], key=repr)
    assert license_matches(empty(spark)).count() == 0


def test_no_python_on_executors(spark):
    plan = license_matches(read(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_notice_of_40_000_words(spark):
    rng = random.Random(6)
    long = [f"v{rng.randint(0, 10**6)}" for _ in range(40_000)]
    notices = spark.createDataFrame([("Long", " ".join(long)), ("MIT", "Released under the MIT License.")], "license string, text string")
    rows = [(1, "before " + " ".join(long)), (2, " ".join(long[: 31_000])), (3, " ".join(long[:29_000])), (4, "x released under the MIT license"), (5, " ".join(long[i] for i in range(0, 40_000, 2)))]
    got = {(r["doc_id"], r["license"]): (r["containment"], r["position"]) for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string"), notices=notices).collect()}
    assert set(got) == {(1, "Long"), (2, "Long"), (4, "MIT")} and got[1, "Long"] == (1.0, 1) and got[4, "MIT"] == (1.0, 1)


def test_bands_decide(spark, monkeypatch):
    """Without an agreeing band nothing is found, whatever the containment."""
    text = NOTICES[16][1]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_matches(docs).count() > 0
    own = licenses.notice_tables
    monkeypatch.setattr(licenses, "notice_tables", lambda notices: (*own(notices)[:2], own(notices)[2].limit(0)))
    assert license_matches(docs).count() == 0
