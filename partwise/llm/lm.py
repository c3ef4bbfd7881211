"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its words in lower case (A-Z only) with one blank after each, as UTF-8
bytes, and an end byte (0xFF, which UTF-8 never holds), so that base and model
price the same words. Each byte is eight binary decisions; every decision has a context tree over the
``DEPTH`` bytes before it, whose nodes hold counts of both outcomes.
Krichevsky-Trofimov estimates of all depths are mixed: a node's weighted
probability is half its own estimate and half the product of its children's.
A trained, frozen tree predicts by the resulting posterior weights along the
context path, which ends early where training never went.

How it runs: documents are dealt into chunks of about ``CHUNK_CHARS``
characters, by a hash of row and partition. A chunk reports its distinct words and grams (byte
and context) with their training counts, packed in one block for each of ``SLOTS`` slots, so
rows grow with the input alone. A slot takes words by their key, and grams by the three bytes next
to the coded one, so that every subtree below depth 3 is whole in it and no pair of bytes, however
frequent, is in one place. Slots are gathered in groups of about ``GROUP_KEYS`` keys, up to one
slot each; blocks of one group are summed key by key, ``BATCH`` chunks together and ``FAN`` sums at a time after that,
before a tree is built. The tree's top (depths 2 to 0: the nodes that occur, at most 65,536 x 255) is summed over the groups.
Each batch of chunks then gets back just the counts and probabilities of its own words and grams. Words are keyed by a 64-bit hash.

Bounds: a chunk and a batch's blocks of a group are bounded by these parameters; a group's distinct keys
are, up to ``SLOTS * GROUP_KEYS`` (two thousand million) distinct grams in all.

Defined cases: a null text is empty: one end token, one end byte; a null
doc_id counts as learned from; equal rows count as often as they occur and are dealt
over the chunks of their partitions; a text longer than a chunk is a chunk of its own, at about 26 bytes of memory a byte (measured on 10 MB); with no
training rows the base score is 0 for each token and each bit has chance 1/2; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, released, stored

DEPTH = 5
#: Subtrees from this depth down are whole in one group.
LEAST = 3
SLOTS, GROUP_KEYS, BATCH, FAN = 512, 4_000_000, 1024, 4
CHUNK_CHARS = 24_000_000
#: Chunks that a small input is dealt into, of at least this many characters.
FEW_CHUNKS, LEAST_CHARS = 12, 5_000_000
SLICE = 500
WORD, GRAM = 0, 1
END = b"\xff"
LEVELS = np.arange(8, dtype=np.uint64)
_PI = float(np.log(np.pi))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series after eight steps up."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    inv = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1) - _PI


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of each text (the bytes before it, oldest first, and itself), and where each text begins."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    parts = [b" ".join([b"\0" * (DEPTH - 1), *words, END]) for words in texts]  # the first blank belongs to the padding
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = len(data) - DEPTH
    key = data[:n].astype(np.uint64)
    for i in range(1, DEPTH + 1):
        key <<= np.uint64(8)
        key |= data[i : i + n]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(n, dtype=bool)
    for i in range(1, DEPTH + 1):  # the padding of a text is context only
        keep[starts[1:] - i] = False
    return key[keep], starts - DEPTH * np.arange(len(parts))


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as byte planes of their differences."""
    steps = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _slot_of(kind: int, keys: np.ndarray) -> np.ndarray:
    """The slot of each (unsigned) key."""
    x = keys if kind == WORD else (keys >> np.uint64(8)) & np.uint64((1 << 8 * LEAST) - 1)
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(SLOTS)


REPORT = "kind byte, chunk int, slot int, size int, keys binary, n binary"
_REPORT = (("kind", pa.int8()), ("chunk", pa.int32()), ("slot", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()))


def _rows(rows: list[tuple], columns: tuple) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(columns)})


def _chunk_counts(table: pa.Table) -> pa.Table:
    """Distinct words and grams of a chunk with their training counts, a row for each kind and slot."""
    found: dict[int, tuple[list, list]] = {WORD: ([], []), GRAM: ([], [])}
    for at in range(0, table.num_rows, SLICE):
        part = table.slice(at, SLICE)
        split = [words_of(t) for t in part.column("text").to_pylist()]
        for flag in (True, False):
            own = [ws for ws, learn in zip(split, part.column("learn").to_pylist()) if learn is flag]
            words = Counter()
            for ws in own:
                words.update(ws)
            grams, times = np.unique(grams_of(own)[0], return_counts=True)
            for kind, key, n in ((WORD, _hashed(words), np.fromiter(words.values(), dtype=np.int64, count=len(words))), (GRAM, grams, times)):
                found[kind][0].append(key)
                found[kind][1].append(n if flag else np.zeros(len(n), dtype=np.int64))
    rows, chunk = [], table.column("chunk")[0].as_py()
    for kind, (keys, times) in found.items():
        key, n = _tally(keys, times)
        slot = _slot_of(kind, key)
        order = np.argsort(slot, kind="stable")  # keys stay ascending within a slot
        ends = np.searchsorted(slot[order], np.arange(SLOTS + 1, dtype=np.uint64))
        for p in range(SLOTS):
            own = order[ends[p] : ends[p + 1]]
            if len(own):
                rows.append((kind, chunk, p, len(own), packed(key[own]), zlib.compress(n[own].astype("<u4").tobytes(), 1)))
    return _rows(rows, _REPORT)


def _tally(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, weights=np.concatenate(times).astype(np.float64), minlength=len(key)).astype(np.int64)


def _hashed(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _blocks(table: pa.Table, kind: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, keys, counts) of a table's blocks of one kind."""
    columns = (table.column(c).to_pylist() for c in ("kind", "chunk", "keys", "n"))
    return [(c, unpacked(k), np.frombuffer(zlib.decompress(n), dtype="<u8" if c < 0 else "<u4")) for x, c, k, n in zip(*columns) if x == kind]  # sums have no chunk


def _by_kind(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their sums; a slot's keys may be in several blocks of one chunk."""
    if len(blocks) == 1:  # a block's keys are distinct and in order
        return blocks[0][1], blocks[0][2].astype(np.int64)
    return _tally([k for _, k, _ in blocks], [n for _, _, n in blocks])


SUMS = "kind byte, grp int, batch int, chunk int, keys binary, n binary"
_SUMS = (("kind", pa.int8()), ("grp", pa.int32()), ("batch", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()))


def _merged(table: pa.Table) -> pa.Table:
    """One block for each kind: distinct keys of a group and batch with their sums (64 bits)."""
    where, rows = (table.column("grp")[0].as_py(), table.column("batch")[0].as_py()), []
    for kind in (WORD, GRAM):
        keys, sums = _by_kind(_blocks(table, kind))
        if len(keys):
            rows.append((kind, *where, -1, packed(keys), zlib.compress(sums.astype("<u8").tobytes(), 1)))
    return _rows(rows, _SUMS)


class Subtrees:
    """Nodes of depth ``LEAST`` and below of the grams of a partition."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        byte = (grams & np.uint64(0xFF))[None, :]
        self.prefix = (np.uint64(1) << LEVELS[:, None]) | (byte >> (np.uint64(8) - LEVELS[:, None]))
        self.bit = ((byte >> (np.uint64(7) - LEVELS[:, None])) & np.uint64(1)).astype(np.int64)
        self.ids, self.at, self.n0, self.n1, self.own, self.below, self.weighted = {}, {}, {}, {}, {}, {}, {}
        weight = np.broadcast_to(counts.astype(np.float64), self.bit.shape).ravel()
        for d in range(DEPTH, LEAST - 1, -1):
            node = (self._context(grams, d) << np.uint64(8))[None, :] | self.prefix
            ids, at = np.unique(node.ravel(), return_inverse=True)
            ones = np.bincount(at, weights=weight * self.bit.ravel(), minlength=len(ids))
            both = np.bincount(at, weights=weight, minlength=len(ids))
            self.ids[d], self.at[d], self.n0[d], self.n1[d] = ids, at.reshape(self.bit.shape), both - ones, ones
            self.own[d] = kt_log(both - ones, ones)
            if d == DEPTH:
                self.weighted[d] = self.own[d]
            else:
                upper = self.ids[d + 1]
                parent = (self._context(upper, d) << np.uint64(8)) | (upper & np.uint64(0xFF))
                self.below[d] = np.bincount(np.searchsorted(ids, parent), weights=self.weighted[d + 1], minlength=len(ids))
                self.weighted[d] = np.logaddexp(self.own[d], self.below[d]) - np.log(2)

    @staticmethod
    def _context(grams: np.ndarray, depth: int) -> np.ndarray:
        """The context of a gram or node, cut to a depth."""
        return (grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)

    def top(self) -> tuple[np.ndarray, ...]:
        """Sums for the nodes one level above: context and prefix in one number, n0, n1, weighted."""
        ids = self.ids[LEAST]
        up = (self._context(ids, LEAST - 1) << np.uint64(8)) | (ids & np.uint64(0xFF))
        found, at = np.unique(up, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(found)) for x in (self.n0[LEAST], self.n1[LEAST], self.weighted[LEAST])]
        return found.astype(np.int64), *sums

    def log10_probability(self, grams: np.ndarray, top: Top) -> np.ndarray:
        chance, seen = None, None
        for d in range(DEPTH, -1, -1):
            if d >= LEAST:
                at = self.at[d]
                n0, n1 = self.n0[d][at], self.n1[d][at]
                odds = (self.own[d] - self.below[d])[at] if d < DEPTH else None
            else:
                node = self.ids[LEAST]
                at = np.searchsorted(top.ids[d], ((self._context(node, d) << np.uint64(8)) | (node & np.uint64(0xFF))).astype(np.int64))[self.at[LEAST]]
                n0, n1, odds = top.n0[d][at], top.n1[d][at], top.odds[d][at]
            total = n0 + n1
            own = (np.where(self.bit == 1, n1, n0) + 0.5) / (total + 1)
            if chance is None:
                chance = own
            else:
                w = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
                chance = np.where(seen, w * own + (1 - w) * chance, own)
            seen = total > 0
        return np.log10(chance).sum(axis=0)


class Top:
    """The nodes above depth ``LEAST`` that occur, by depth: context and prefix in one number, ascending."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        rows = sorted(rows)
        ids, (n0, n1, below) = np.array([r[0] for r in rows], dtype=np.int64), (np.array([r[i] for r in rows], dtype=np.float64) for i in (1, 2, 3))
        self.ids, self.n0, self.n1, self.odds = {}, {}, {}, {}
        for d in range(LEAST - 1, -1, -1):
            own = kt_log(n0, n1)
            self.ids[d], self.n0[d], self.n1[d], self.odds[d] = ids, n0, n1, own - below
            weighted = np.logaddexp(own, below) - np.log(2)
            above = ((ids >> 8) & ((1 << 8 * (d - 1)) - 1 if d else 0)) << 8 | (ids & 0xFF)
            ids, at = np.unique(above, return_inverse=True)
            n0, n1, below = (np.bincount(at, weights=x, minlength=len(ids)) for x in (n0, n1, weighted))


TOPS = "node long, n0 double, n1 double, weighted double"
#: The row of a part's words among the tops: n0 is how many are known, n1 the sum of their counts.
WORDS_NODE = -1


def _tops(table: pa.Table) -> pa.Table:
    _, sums = _by_kind(_blocks(table, WORD))
    grams, counts = _by_kind(_blocks(table, GRAM))
    columns = [np.array([WORDS_NODE]), np.array([(sums > 0).sum()], dtype=np.float64), np.array([sums.sum()], dtype=np.float64), np.zeros(1)]
    if len(grams):
        columns = [np.concatenate(pair) for pair in zip(columns, Subtrees(grams, counts).top())]
    return pa.table(dict(zip(("node", "n0", "n1", "weighted"), map(pa.array, columns))))


ANSWER = "kind byte, chunk int, keys binary, vals binary"


def _answers(top):
    """Counts of words and log probabilities of grams, packed for each chunk of a batch that reported them."""

    def answer(asked: pa.Table, sums: pa.Table) -> pa.Table:
        rows = []
        words, counts = _by_kind(_blocks(sums, WORD))
        rows += [(WORD, c, packed(k), zlib.compress(counts[np.searchsorted(words, k)].astype("<i8").tobytes(), 1)) for c, k, _ in _blocks(asked, WORD)]
        grams, counts = _by_kind(_blocks(sums, GRAM))
        if len(grams):
            chance = Subtrees(grams, counts).log10_probability(grams, top.value).astype("<f4")
            rows += [(GRAM, c, packed(k), chance[np.searchsorted(grams, k)].tobytes()) for c, k, _ in _blocks(asked, GRAM)]
        return _rows(rows, (("kind", pa.int8()), ("chunk", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())))

    return answer


def _chunk_scores(tokens: int, distinct: int, ends: int):
    """Scores of a chunk's documents from the answers to its words and grams."""

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tables = {}
        for kind in (WORD, GRAM):
            own = [(unpacked(k), np.frombuffer(zlib.decompress(v), dtype="<i8") if kind == WORD else np.frombuffer(v, dtype="<f4")) for x, k, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "vals"))) if x == kind]
            key = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in own]])
            value = np.concatenate([np.empty(0), *[v for _, v in own]])
            order = np.argsort(key)
            tables[kind] = key[order], value[order]
        word_keys, counts = tables[WORD]
        total = max(1, tokens + distinct + 1)
        base, known = np.log10((counts + 1) / total), counts > 0
        end_base = float(np.log10((ends + 1) / total))
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        for at in range(0, docs.num_rows, SLICE):
            texts = docs.column("text").slice(at, SLICE).to_pylist()
            split = [words_of(t) for t in texts]
            new = list(set().union(*split))
            number = dict(zip(new, np.searchsorted(word_keys, _hashed(new)).tolist()))
            for ws in split:
                i = np.fromiter(map(number.__getitem__, ws), dtype=np.int64, count=len(ws))
                out["n_tokens"].append(len(ws) + 1)
                out["n_known"].append(int(known[i].sum()) + (ends > 0))
                out["base_score"].append(float(base[i].sum()) + end_base)
            gram, starts = grams_of(split)
            mine = np.unique(gram)
            at_key = np.minimum(np.searchsorted(tables[GRAM][0], mine), max(0, len(tables[GRAM][0]) - 1))
            if not np.array_equal(tables[GRAM][0][at_key], mine):
                raise RuntimeError("rows were dealt to other chunks than before: the documents do not read alike twice")
            chance = tables[GRAM][1][at_key]
            score = np.add.reduceat(chance[np.searchsorted(mine, gram)], starts)
            out["score"] += score.tolist()
            out["bits_per_byte"] += (-score * np.log2(10) / np.diff(np.append(starts, len(gram)))).tolist()
        n = docs.num_rows
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": pa.array([not x for x in docs.column("learn").to_pylist()], pa.bool_()),
                "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()),
                "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()), "bits_per_byte": pa.array(out["bits_per_byte"], pa.float64()),
            }
        )

    return score


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def scored(docs: DataFrame, doc_id="doc_id", text="text", folds: int = 7, held: int = 2) -> DataFrame:
    """Base (word unigram) and context-tree scores of every whole text, and the code length per byte that the tree gives it."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c"), F.count("*").alias("n")).first()
    chunks = max(1, -(-size["c"] // CHUNK_CHARS), -(-size["n"] // 200_000), min(FEW_CHUNKS, size["c"] // LEAST_CHARS))
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0))
    docs = docs.withColumn("learn", remainder != held).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int"))

    reports = stored(docs.groupBy("chunk").applyInArrow(_chunk_counts, REPORT), "lm-counts")
    released(spark)
    keys = reports.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups, batches = min(SLOTS, max(1, -(-keys // GROUP_KEYS))), -(-chunks // BATCH)
    grouped = reports.select("kind", "chunk", (F.col("slot") % groups).alias("grp"), F.floor(F.col("chunk") / BATCH).cast("int").alias("batch"), "keys", "n")
    sums = stored(grouped.groupBy("grp", "batch").applyInArrow(_merged, SUMS), "lm-sums")
    left = batches
    while left > 1:
        narrower = sums.withColumn("batch", F.floor(F.col("batch") / FAN).cast("int"))
        before, sums, left = sums, stored(narrower.groupBy("grp", "batch").applyInArrow(_merged, SUMS), "lm-sums"), -(-left // FAN)
        forget(before)
    rows = sums.groupBy("grp").applyInArrow(_tops, TOPS).groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("w")).collect()  # the nodes of depth 2 that occur, and one
    top = spark.sparkContext.broadcast(Top([tuple(r) for r in rows if r["node"] != WORDS_NODE]))
    ends = docs.where("learn").count()
    known, times = next(((int(r["n0"]), int(r["n1"])) for r in rows if r["node"] == WORDS_NODE), (0, 0))
    released(spark)
    each = sums.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(max(0, batches - 1)))))
    answers = grouped.groupBy("grp", "batch").cogroup(each.groupBy("grp", "batch")).applyInArrow(_answers(top), ANSWER)
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_chunk_scores(times + ends, known + (ends > 0), ends), RESULT)
