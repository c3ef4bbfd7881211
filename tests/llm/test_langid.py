import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from partwise.llm import langid
from partwise.llm.common import read
from partwise.llm.queries import op10_language_id

from helpers import awkward, crc_mod, empty

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in read(spark, SF, "documents").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (crc_mod(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_predictions_do_not_read_labels(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs.where(langid.fold(docs["doc_id"]) != 0).select("doc_id", "text", "lang"))
    a = langid.predict(docs.select("doc_id", "text"), model).collect()
    b = {r["doc_id"]: r["_lang_pred"] for r in langid.identified(docs, ["doc_id", "text"]).collect()}
    assert {r["doc_id"]: r["_lang_pred"] for r in a} == b


def test_awkward_rows(spark):
    got = langid.identified(awkward(spark), awkward(spark).columns)
    assert got.count() == 10
    for r in got.collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["_lang_pred"], r["_lang_score"]) == ("und", 0.0)
        else:
            assert r["_lang_pred"] in ("en", "fr", "de") and 1 / 3 <= r["_lang_score"] <= 1
    assert langid.identified(empty(spark), ["doc_id", "text"]).count() == 0
    none = spark.createDataFrame([(1, "text without label", None)], "doc_id long, text string, lang string")
    assert langid.identified(none, ["doc_id", "text"]).first()["_lang_pred"] == "und"


def test_letters():
    assert langid.has_letter("½ é") and not langid.has_letter("½ ² 12 _") and not langid.has_letter("") and not langid.has_letter(None)


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    z, n = np.zeros((50, 2)), np.zeros((50, 2))
    for _ in range(400):
        y = int(rng.integers(2))
        idx = np.array([y, 2 + int(rng.integers(48))])
        langid.ftrl_step(z, n, idx, np.array([0.8, 0.6]), y)
    w = langid.ftrl_weights(z, n)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w == 0).any()


def plain_buckets(text):
    """All n-grams of a text as the docstring says, number by number."""
    c = [32]
    for ch in text.lower():
        x = ord(ch) if ch.isalpha() else 32
        if x != 32 or c[-1] != 32:
            c.append(x)
    if c[-1] != 32:
        c.append(32)
    m, out = 2**32, []
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h * 0x01000193 + x) % m
            x = (h ^ (n * 0x9E3779B1 % m)) * 0x85EBCA6B % m
            out.append((x ^ (x >> 13)) * 0xC2B2AE35 % m >> 17)
    return sorted(out)


def test_features_against_a_plain_version():
    for text in ("a", "Äpfel & Birnen,  süß!", "x1y", " lead and trail ", "日本語 text", "aaaa"):
        assert sorted(langid.ngram_buckets(text).tolist()) == plain_buckets(text)


class PlainModel:
    """The whole method over dictionaries: counts, idf, averaged FTRL shards, temperature, probabilities."""

    def __init__(self, rows, hashes):
        rows = [(i, t, lang) for i, t, lang in rows if t is not None and lang is not None]
        self.languages = sorted({lang for *_, lang in rows})
        spelled = [(i, t, lang) for i, t, lang in rows if any(map(str.isalpha, t))]
        times = Counter(f for _, t, _ in spelled for f in set(plain_buckets(t)))
        self.idf = lambda f: math.log((1 + len(spelled)) / (1 + times[f])) + 1
        sample = [(i, self.languages.index(lang), self.vector(t)) for i, t, lang in spelled]
        held = [r for r in sample if crc_mod(r[0], 25) % 6 == 0]
        self.weights = self.learn([r for r in sample if crc_mod(r[0], 25) % 6], hashes)
        grid = [math.exp(math.log(0.02) + k * (math.log(5) - math.log(0.02)) / 119) for k in range(120)]
        loss = lambda t: -sum(math.log(max(self.chances(x, t)[y], 1e-12)) for _, y, x in held)
        self.temperature = min(grid, key=loss) if held else 1.0

    def vector(self, text):
        x = {f: n * self.idf(f) for f, n in Counter(plain_buckets(text)).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / norm for f, v in x.items()}

    def learn(self, rows, hashes):
        k, state = len(self.languages), {}
        for epoch in range(langid.EPOCHS):
            shards = defaultdict(list)
            for r in rows:
                shards[hashes[r[0]][0] % langid.SHARDS].append(r)
            ends = []
            for own in shards.values():
                now = {f: [v[:] for v in zn] for f, zn in state.items()}
                for _, y, x in sorted(own, key=lambda r: hashes[r[0]][1 + epoch]):
                    w = {f: [self.weight(z, n) for z, n in zip(*now.get(f, ([0.0] * k, [0.0] * k)))] for f in x}
                    p = self.soft([sum(v * w[f][c] for f, v in x.items()) for c in range(k)])
                    for f, v in x.items():
                        z, n = now.setdefault(f, [[0.0] * k, [0.0] * k])
                        for c in range(k):
                            g = v * (p[c] - (c == y))
                            z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / langid.ALPHA * w[f][c]
                            n[c] += g * g
                ends.append(now)
            zero = [[0.0] * k, [0.0] * k]
            state = {f: [[sum(e.get(f, zero)[j][c] for e in ends) / len(ends) for c in range(k)] for j in (0, 1)] for f in set().union(*ends)}
        return {f: [self.weight(z, n) for z, n in zip(*zn)] for f, zn in state.items()}

    @staticmethod
    def weight(z, n):
        return 0.0 if abs(z) <= langid.L1 else -(z - math.copysign(langid.L1, z)) / ((langid.BETA + math.sqrt(n)) / langid.ALPHA + langid.L2)

    @staticmethod
    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def chances(self, x, temperature):
        none = [0.0] * len(self.languages)
        return self.soft([sum(v * self.weights.get(f, none)[c] for f, v in x.items()) / temperature for c in range(len(self.languages))])

    def predict(self, text):
        if not self.languages or not any(map(str.isalpha, text or "")):
            return "und", 0.0
        p = self.chances(self.vector(text), self.temperature)
        return self.languages[p.index(max(p))], max(p)


def test_predictions_against_the_whole_method_in_plain_python(spark):
    """Statistics, weights of three epochs in shards, temperature and probabilities, recomputed over dictionaries."""
    rows = [(r["doc_id"], (r["text"] or "")[:160], r["lang"]) for r in read(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]
    rows += [(1000, None, "en"), (1001, "no label", None), (1002, "1 2 3", "en"), (1003, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(langid.SHARDS)).alias("s"), *[F.xxhash64("doc_id", F.lit(e)).alias(f"e{e}") for e in range(langid.EPOCHS)]).collect()
    plain = PlainModel([r for r in rows if crc_mod(r[0], 5) != 0], {r["doc_id"]: tuple(r)[1:] for r in hashed})
    model = langid.model_of(docs)
    assert model.languages == plain.languages and abs(model.temperature - plain.temperature) < 1e-9
    got = {r["doc_id"]: (r["_lang_pred"], r["_lang_score"]) for r in langid.identified(docs, ["doc_id", "text"]).collect()}
    for i, text, _ in rows:
        name, score = plain.predict(text)
        assert got[i][0] == name and abs(got[i][1] - score) < 1e-6, (i, got[i], name, score)
