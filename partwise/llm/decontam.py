"""Benchmark decontamination with an FM-index per training shard.

Test phrases are the windows of ``width`` consecutive words of a benchmark item
(an item of fewer words is one phrase). A shard of documents is projected on
the words that the phrases use: any other word can't be part of a match and
becomes a separator, and runs shorter than the shortest phrase go as well. Over
the remaining runs the shard's suffix array gives the Burrows-Wheeler text,
kept as a wavelet matrix; all phrases are searched backwards at once, their
rows are located by walking to sampled suffix positions, and the occurrences
are merged into removal spans.

Benchmarks go in blocks of about ``block_chars`` characters, each broadcast for one
pass over the documents: equal items are one, and a long item is cut into stretches
that overlap by ``width - 1`` words. Spans of several passes are merged, and a table
is stored between passes so that the plan stays of one size; the table before goes.

Defined cases: a null text has no words and no hits; a null item text has no
phrase; a null item id reads ``null``; a very long text is a shard of its own, whose
arrays take some 60 bytes a word that phrases use; equal rows are judged alike, each in a
row of its own; other columns are handed through by position (one named like a
result, ``_found_...``, gives way to it); empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, packed_schema, row_of, rows_again, stored, use_memory, with_results

#: Word bytes are 0-9, a-z (A-Z lower-cased) and everything above 0x7F.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
END = b"~"  # never a word, so it marks the end of a document
SHARD, SHARD_BYTES = 2000, 16 << 20
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Phrases:
    """Distinct phrases as word numbers, with the items that they come from."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in found for w in p}))}
        self.items = [sorted(x) for x in found.values()]
        self.sizes = np.array([len(p) for p in found], dtype=np.int64)
        self.words = np.zeros((len(found), int(self.sizes.max(initial=0))), dtype=np.int64)  # right-aligned
        for i, p in enumerate(found):
            self.words[i, -len(p) :] = [self.vocabulary[w] for w in p]


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling."""
    n, k = len(ranks), 1
    _, rank = np.unique(ranks, return_inverse=True)
    rank = rank.astype(np.int64)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = new
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class Wavelet:
    """Wavelet matrix of a symbol sequence: rank and access for arrays of positions."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, at = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[i][low], self.ones[i][at]
            low, at = np.where(one, self.zeros[i] + a, low - a), np.where(one, self.zeros[i] + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for i in range(self.bits):
            before = self.ones[i][at].astype(np.int64)
            bit = self.ones[i][at + 1] - before
            out = (out << 1) | bit
            at = np.where(bit == 1, self.zeros[i] + before, at - before)
        return out


class FMIndex:
    """Over runs of word numbers; ``text`` has 0 before every run and at the end."""

    def __init__(self, text: np.ndarray, sigma: int):
        cut = text == 0
        separators = int(cut.sum())
        # Separators differ from each other, so no comparison goes beyond a run.
        order = suffix_array(np.where(cut, np.cumsum(cut) - 1, text + separators))
        self.last = Wavelet(text[order - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        run_start = np.concatenate(([False], cut[:-1])) & ~cut
        sampled = (np.arange(len(text)) % SAMPLE == 0) | run_start | cut  # a walk ends in its own run
        self.sampled = sampled[order]
        self.known = np.concatenate(([0], np.cumsum(self.sampled)))
        self.places = order[self.sampled]

    def search(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned phrases."""
        low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.sampled), dtype=np.int64)
        live = np.arange(len(words))
        for step in range(1, words.shape[1] + 1):
            live = live[(sizes[live] >= step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = words[live, -step]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, out, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.sampled[rows[todo]]
            done = todo[there]
            out[done] = self.places[self.known[rows[done]]] + steps[done]
            todo = todo[~there]
            symbol = self.last.access(rows[todo])
            rows[todo] = self.first[symbol] + self.last.rank(symbol, rows[todo])
            steps[todo] += 1
        return out


def scan_shard(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Words, merged hit spans (word positions) and items of each text."""
    n = len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    numbers = dict(phrases.vocabulary)
    numbers[END] = -1
    words = b"".join((t or "").encode("utf-8", "surrogatepass").translate(FOLD) + b" ~ " for t in texts).split()
    ids = np.fromiter(map(numbers.get, words, repeat(0)), dtype=np.int64, count=len(words))
    del words
    ends = np.nonzero(ids == -1)[0]
    n_words = np.diff(np.concatenate(([-1], ends))) - 1
    if not len(phrases.sizes) or not len(ids):
        return n_words, spans, items
    known = ids > 0
    edge = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    long = stop - start >= phrases.sizes.min()
    start, stop = start[long], stop[long]
    if not len(start):
        return n_words, spans, items
    size = stop - start
    at = np.cumsum(size + 1) - size  # where each run begins, after its separator
    text = np.zeros(int(size.sum() + len(size)) + 1, dtype=np.int64)
    own = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    text[at[own] + within] = ids[start[own] + within]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.words, phrases.sizes)
    times = np.maximum(high - low, 0)
    if not times.sum():
        return n_words, spans, items
    phrase = np.repeat(np.arange(len(times)), times)
    rows = np.repeat(low, times) + np.arange(len(phrase)) - np.repeat(np.cumsum(times) - times, times)
    place = index.locate(rows)
    run = np.searchsorted(at, place, side="right") - 1
    word = start[run] + place - at[run]  # position among all words of the shard
    doc = np.searchsorted(ends, word)
    for d, p in np.unique(np.stack((doc, phrase)), axis=1).T.tolist():
        items[d].update(phrases.items[p])
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, word, 1)
    np.add.at(edges, word + phrases.sizes[phrase], -1)
    hit = np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]))
    turn = np.diff(hit)
    first_word = np.concatenate(([0], ends[:-1] + 1))
    for a, b in zip(np.nonzero(turn == 1)[0].tolist(), np.nonzero(turn == -1)[0].tolist()):
        d = int(np.searchsorted(ends, a))
        spans[d].append((a - int(first_word[d]), b - int(first_word[d])))
    return n_words, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def shards(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``SHARD`` rows and, but for a single text, ``SHARD_BYTES`` bytes of text."""
    sizes = np.array(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and (i - lo >= SHARD or total + size > SHARD_BYTES):
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield batch.slice(lo)


def _pass(rows: DataFrame, at: int, phrases: Phrases, first: bool) -> DataFrame:
    """(row) with the results of one block of phrases, those of earlier blocks merged in; ``at``: where a row has its text."""
    sent = rows.sparkSession.sparkContext.broadcast(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("decontam")
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), [at]).cast(pa.string())
            for part in shards(batch.append_column("text", texts), texts):
                n, spans, items = scan_shard(part.column("text").to_pylist(), sent.value)
                if not first:
                    for i, (s, x) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
                        spans[i] = merged(spans[i] + [(y["start"], y["end"]) for y in s])
                        items[i].update(x)
                columns = [
                    part.column("row"), pa.array(n, pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPAN),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_hit", "items", "spans"])

    return rows.mapInArrow(scan, packed_schema(rows, RESULT))


def _pieces(items: DataFrame, width: int, block_chars: int) -> DataFrame:
    """Distinct (item, t): items longer than a quarter of a block as stretches of words that share ``width - 1`` words, so that every window is in one of them."""
    step = max(1, block_chars // 64)
    words = F.regexp_extract_all(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, F.lit(step + width - 1)), " "))
    long = items.where(F.length("t") > block_chars // 4).select("item", words.alias("words")).select("item", F.explode(cut).alias("t"))
    return items.where(F.length("t") <= block_chars // 4).unionByName(long).distinct()


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, width: int, block_chars: int) -> DataFrame:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("t"))
    items = stored(_pieces(items, width, block_chars), "decontam-items")
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    out, before = docs.select(row_of(docs).alias("row")), None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).collect()  # bounded by block_chars
        out = _pass(out, docs.columns.index(text), Phrases([(r["item"], r["t"]) for r in own], width), b == 0)
        if blocks > 1:
            out = stored(out, "decontam-block")
            if before is not None:
                forget(before)
            before = out
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", width: int = 10, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` with ``_found_n_words``, ``_found_n_hit``, ``_found_items`` and ``_found_spans``."""
    found = _searched(docs, benchmark, text, item_id, item_text, width, block_chars)
    return with_results(found, docs, {f"_found_{c}": c for c in ("n_words", "n_hit", "items", "spans")})


def decontaminated(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", width: int = 10, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, columns as given."""
    return rows_again(_searched(docs, benchmark, text, item_id, item_text, width, block_chars).where("n_hit = 0"), docs)
