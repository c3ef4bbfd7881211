"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of non-letters becomes one blank, and
n-grams of 1 to ``ORDERS`` characters are hashed into ``BUCKETS`` features with
L2-normalised ``tf * idf``. Document frequencies cover all learning rows. The
weights are learned by follow-the-regularised-leader (FTRL-proximal) with an
elastic net, in shards whose states are averaged after each epoch; a
temperature then calibrates the probabilities on rows kept back for that.

The classifier sees a bounded sample of the learning rows: about
``per_language`` rows of each language, drawn by a hash of doc_id. Everything
else (document frequencies, predictions) covers all rows and whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; a very
long text is read whole by one worker, at about 66 bytes of memory a byte (measured on 10 MB);
rows with null lang or null doc_id are not learned from (a null doc_id counts
as held out); without any learning row every text is ``und``; ties go to the
first language in code-point order. Other columns are handed through by position
(one named like a result, ``_lang_...``, gives way to it). Equal rows are drawn for
the sample together; an empty table gives an empty result. A model takes half a
megabyte for each distinct ``lang`` value, which driver and workers hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_schema, quoted, row_of, rows_again, stored, use_memory, with_results

BUCKETS = 1 << 15
ORDERS = 3
UNKNOWN = "und"
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
SHARDS, EPOCHS = 4, 3

_letters: np.ndarray | None = None
_maybe_letter = re.compile(r"[^\W\d_]")


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    m = _maybe_letter.search(text)
    return bool(m) and (m.group().isalpha() or any(map(str.isalpha, text)))


def ngram_buckets(text: str) -> np.ndarray:
    """Feature numbers of all n-grams of a text, repeats included."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[raw]
    c = np.concatenate(([32], np.where(letter, raw, 32), [32])).astype(np.uint32)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    out, h = [], np.zeros(len(c), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
        x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        out.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 15))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        times = np.bincount(ngram_buckets(text), minlength=BUCKETS)
        idx = np.flatnonzero(times)
        v = times[idx] * self.idf[idx]
        return v @ self.weights[idx] / np.sqrt(v @ v)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) > L1, w, 0.0)


def ftrl_step(z: np.ndarray, n: np.ndarray, idx: np.ndarray, x: np.ndarray, y: int) -> None:
    """One example; z and n (features x languages) change in place."""
    w = ftrl_weights(z[idx], n[idx])
    p = softmax(x @ w)
    p[y] -= 1
    g = np.outer(x, p)
    z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA * w
    n[idx] += g * g


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _statistics(rows: DataFrame) -> np.ndarray:
    """In how many of the texts each feature occurs; last, how many texts have a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("langid")
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for text in batch.column(0).slice(at, 1000).to_pylist():
                    if has_letter(text):
                        total[:-1] += np.bincount(ngram_buckets(text), minlength=BUCKETS) > 0
                        total[-1] += 1
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["feature", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in rows.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]  # at most BUCKETS + 1 rows
    return out


def _features(rows: DataFrame, languages: list[str], idf: np.ndarray) -> DataFrame:
    """(doc_id, y, idx, x) of the sample."""
    number = {name: i for i, name in enumerate(languages)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("langid")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for key, lang, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if has_letter(text):
                        idx, tf = np.unique(ngram_buckets(text), return_counts=True)
                        x = tf * idf[idx]
                        out.append((key, number[lang], idx.astype(np.int32).tobytes(), (x / np.sqrt(x @ x)).tobytes()))
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "y", "idx", "x"])

    return rows.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(build, "doc_id long, y int, idx binary, x binary")


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for y, idx, x in zip(batch.column("y").to_pylist(), batch.column("idx").to_pylist(), batch.column("x").to_pylist()):
        yield y, np.frombuffer(idx, dtype=np.int32), np.frombuffer(x, dtype=np.float64)


def _learn(sample: DataFrame, n_languages: int) -> np.ndarray:
    """Weights: each epoch, every shard goes on from the averaged state over its own rows."""
    spark = sample.sparkSession
    z, n = np.zeros((BUCKETS, n_languages)), np.zeros((BUCKETS, n_languages))
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))  # BUCKETS x languages

        def train(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own_z, own_n = (x.copy() for x in state.value)
            seen = 0
            for batch in batches:
                for y, idx, x in _unpack(batch):
                    ftrl_step(own_z, own_n, idx, x, y)
                    seen += 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([own_z.tobytes()]), pa.array([own_n.tobytes()])], ["z", "n"])

        order = F.xxhash64("doc_id", F.lit(epoch))
        dealt = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")).repartitionById(SHARDS, F.col("shard")).sortWithinPartitions(order, "y", "idx")
        states = dealt.select("y", "idx", "x").mapInArrow(train, "z binary, n binary").collect()
        if not states:
            break
        z = np.mean([np.frombuffer(s["z"]) for s in states], axis=0).reshape(z.shape)
        n = np.mean([np.frombuffer(s["n"]) for s in states], axis=0).reshape(n.shape)
        state.unpersist()
    return ftrl_weights(z, n)


def _temperature(sample: DataFrame, weights: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the weights were not learned from."""
    sent = sample.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(y, (x @ sent.value[idx]).tobytes()) for y, idx, x in _unpack(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["y", "logits"])

    rows = sample.mapInArrow(score, "y int, logits binary").collect()  # the bounded sample
    if not rows:
        return 1.0
    y, logits = np.array([r["y"] for r in rows]), np.stack([np.frombuffer(r["logits"]) for r in rows])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def train(rows: DataFrame, per_language: int = 1500) -> Model:
    """A model of (doc_id, text, lang) rows; ``per_language`` bounds the classifier's sample."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)))
    found = _statistics(rows)
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("sample")), 11) / float(2**53)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(share)
    sample = stored(_features(rows.where(chance < share), languages, idf), "langid-sample")
    held = fold(F.col("doc_id"), 25) % 6 == 0  # for the temperature
    weights = _learn(sample.where(~held), len(languages))
    return Model(languages, idf, weights, _temperature(sample.where(held), weights))


def _predicted(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """row (all columns of ``docs``), pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).cast("string").alias("text"), row_of(docs).alias("row"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("langid")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [sent.value.predict(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["row", "pred", "score"])

    return rows.mapInArrow(apply, packed_schema(rows, "pred string, score double"))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``_lang_pred`` and ``_lang_score``."""
    return with_results(_predicted(docs, model, text), docs, {"_lang_pred": "pred", "_lang_score": "score"})


def model_of(docs: DataFrame, folds: int = 5, per_language: int = 1500) -> Model:
    """A model of the rows of docs (doc_id, text, lang) outside fold 0."""
    return train(docs.where(fold(F.col("doc_id"), folds) != 0).select("doc_id", "text", "lang"), per_language)


def recognised(docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` whose predicted language has a calibrated probability of ``least`` or more; columns as given."""
    found = _predicted(docs, model_of(docs), "text")
    return rows_again(found.where((F.col("pred") != UNKNOWN) & (F.col("score") >= least)), docs)


def identified(docs: DataFrame, keep: list[str], folds: int = 5, per_language: int = 1500) -> DataFrame:
    """``keep`` columns of docs with the prediction of its model."""
    return predict(docs.select(*map(quoted, keep)), model_of(docs, folds, per_language))
