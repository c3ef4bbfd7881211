import hashlib
import re

import pytest

from partwise.llm import pii
from partwise.llm.common import read
from partwise.llm.queries import op8_pii_bootstrap

from helpers import awkward, empty

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@pytest.mark.parametrize(
    "text",
    ["a@b.co", "a@b a@b.c.d@e.f_x@y.z", "@@a@b.c", "x@.com é@b.co", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255", "4111 1111-1111 1111 4111111111111112", "+1 (212) 555-0100. +44--1", "+1+2+3 555 0100 99 ", "mail a.b+c%d@x-y.z-w.q.", "1.2.3 4.5.6.7x8.9.1.2", "9" * 5000, "a" * 5000 + "@b.c", "1." * 3000, "+1 " * 2000],
)
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_query_against_plain_version(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").collect()}
    rows = op8_pii_bootstrap(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r["spans"].split(","))) | {""}


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"please call support at +1 212 555 01{i:02d} now") for i in range(20)]
    rows += [(100, "please call support at 212-555-0199 now"), (101, "chapter version 212-555-0199 follows")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    assert got[100] == "phone:23:35"
    assert got[101] == ""
    assert got[3] == "phone:23:38"


def test_awkward_rows(spark):
    docs = awkward(spark, [(20, "mail x@y.zz or 10.0.0.1", "en", "a"), (20, "mail x@y.zz or 10.0.0.1", "en", "a")])
    got = pii.personal_data(docs)
    assert got.count() == docs.count()
    for r in got.where("doc_id = 20").collect():
        assert r["spans"] == "email:5:11,ip:15:23" and r["n_email"] == 1
    assert pii.personal_data(empty(spark)).count() == 0


@pytest.mark.parametrize("said", ["0171 555 1234", "DE89 3704 0044 0532", "4111 1111 1111 1112", "(0171) 555-1234", "0171.555.1234", "0171(555)1234", "anna@localhost", "jane.doe@intranet", "AB-1234567"])
def test_every_form_is_a_mention(said):
    text = f"call them at {said}, please"
    assert (13, 13 + len(said)) in {(a, b) for _, a, b, _, _ in pii.mentions(text, pii.base_spans(text))}


def test_runs_end_at_base_spans_and_tokens_stay():
    text = "from 0171 555 1234 10.0.0.1 2024 12345678"
    assert {(k, text[a:b]) for k, a, b, _, _ in pii.mentions(text, pii.base_spans(text))} == {("", "0171 555 1234"), ("ip", "10.0.0.1"), ("", "2024 12345678"), ("", "12345678")}
    assert [m[1:3] for m in pii.mentions("(12345678) x", [])] == [(1, 9)]


def test_long_tokens_are_read_once():
    for text in ("a1" * 200_000, "1 " * 200_000, "(1" * 200_000, "1) (" * 100_000, "a@" * 100_000):
        assert len(pii.mentions(text, pii.base_spans(text))) < 10


def test_identifiers_with_blanks_are_found_whole(spark):
    rows = [(i, f"please call support at +1 212 555 01{i:02d} now") for i in range(20)]
    rows += [(100, "please call support at 0171 5551234 now"), (101, "please call support at anna@localhost now")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:23:35"
    assert got[101] == "phone:23:37"


def brute_added(rows):
    """The graph scorer again, with dictionaries: added spans by doc_id."""
    known, of, places = {}, {}, []
    for i, text in rows:
        for kind, a, b, patterns, instance in pii.mentions(text or "", pii.base_spans(text or "")):
            if kind:
                known[instance] = min(pii.EVERY.index(kind), known.get(instance, 9))
            for p in patterns:
                of.setdefault(p, set()).add(instance)
            if kind not in pii.KINDS:
                places.append((i, a, b, patterns))
    while True:
        good = {}
        for p, own in of.items():
            hits = [sum(known.get(x) == k for x in own) for k in range(len(pii.EVERY))]
            best = max(range(len(hits)), key=lambda k: (hits[k], -k))
            if hits[best] >= pii.SUPPORT and hits[best] >= pii.CONFIDENCE * len(own):
                good[p] = best
        more = dict(known)
        for p, k in good.items():
            for x in of[p]:
                more[x] = min(k, more.get(x, 9))
        if more == known:
            break
        known = more
    found = {}
    for i, a, b, patterns in places:
        if any(p in good for p in patterns):
            found.setdefault(i, set()).add((pii.EVERY[min(good[p] for p in patterns if p in good)], a, b))
    return {i: sorted(f"{k}:{a}:{b}" for k, a, b in own if not any(c <= a and b <= d and (c, d) != (a, b) for _, c, d in own)) for i, own in found.items()}


def test_added_spans_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    want = brute_added(rows)
    got = {}
    for r in op8_pii_bootstrap(spark, sf).collect():
        base = {f"{k}:{a}:{b}" for k, a, b in brute(dict(rows)[r["doc_id"]] or "")}
        more = sorted(set(filter(None, r["spans"].split(","))) - base)
        assert len(more) == r["n_added"]
        if more:
            got[r["doc_id"]] = more
    assert got == want and len(got) > 5


def test_planted_secrets_are_found_and_other_tokens_left_alone(spark):
    rows = [(i, f"word{i} api_key: {hashlib.sha1(str(i).encode()).hexdigest()} here") for i in range(30)]
    rows += [(100, "other api_key: Zx81-QQtr-9917-aaTT-0042 here"), (101, "part no. Zx81-QQtr-9917-aaTT-0043 here"), (102, "commit " + hashlib.sha1(b"c").hexdigest() + " by us")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "secret:15:39" and got[101] == "" and got[102] == ""
    assert all(got[i].startswith("secret:") for i in range(30))


def test_rounds_go_on_to_the_last_generation(spark):
    # Nine of ten instances of a pattern are those of the one before; only the first has nine seeds.
    chain = [(f"p{g}", f"i{g + k}") for g in range(5) for k in range(10)]
    seeds = {f"i{k}" for k in range(9)}
    table = spark.createDataFrame([(p, i, 0 if i in seeds else len(pii.EVERY)) for p, i in chain], "pattern string, instance string, rank int")
    assert {r["pattern"] for r in pii.good_patterns(table).collect()} == {f"p{g}" for g in range(5)}
    assert {r["pattern"] for r in pii.good_patterns(table, rounds=2).collect()} == {"p0", "p1"}
