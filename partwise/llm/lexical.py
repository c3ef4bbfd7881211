"""Ranked lexical search by TPUT, the three-phase uniform threshold algorithm, over posting lists.

A document scores, for a query, the sum over the query's terms (repeats included)
of ``w * impact``: ``w = floor(1000 ln((2N+2) / (2df+1)))``, ``impact = 10^9 tf div (1000 tf + 12 m)``,
``m = 75 + (25 n N) div L``; N counts documents with terms, L all terms, n those of the document.

*Lists.* One pass over the documents writes the posting list of every term that
is asked for, in segments: one row a term and chunk of documents, its entries in
descending order of impact. A chunk holds at most ``CHUNK_DOCS`` documents and
closes at ``CHUNK_BYTES`` of text, so no segment and no chunk grows with the data; the
rows are dealt by (term, chunk), which keeps the list of a frequent word on many
machines, and sorted by term within a file, so that files are skipped by term.

1. *Heads.* The k best entries of each list (merged in every task first) give partial
   sums; the k-th best of a query is its first threshold ``t1``.
2. *Uniform threshold.* Of a query of ``l`` lists every list sends all entries that
   contribute ``ceil(t1 / l)`` or more. They meet by chunk, where they add up
   to a lower bound of each document; every list that did not send it adds at
   most that threshold less one, and at most the list's best, to the upper
   bound. Documents whose upper bound falls below ``t1``, or below the k-th best
   lower bound of their chunk, are out. The k-th best lower bound of all is ``t2``.
3. *Look-up.* Documents whose upper bound reaches ``t2`` are scored exactly from the
   segments of their chunk; the k best of each chunk are merged by rank.

Candidates travel as packed arrays, one row for a query and chunk, so that groups of
equal documents, which all tie, add no rows. Queries go in blocks of ``block_terms``
(term, query) pairs; the terms of a block are broadcast, its lists written once.

Defined cases: null texts and texts without a term match nothing and count
nowhere; documents are rows: one id in several rows is ranked once for each; a null
id comes last among equals; query rows of one id ask once, with their smallest
non-null text; queries without a term, or none of whose terms occurs, have no
result; a list whose w is 0 adds nothing; very long texts are read in stretches
of ``STRETCH`` bytes; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import forget, new_path, stored

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_DOCS = 1 << 16
CHUNK_BYTES = 16 << 20
STRETCH = 1 << 20
#: Terms of text for each file of lists: at most 8 bytes each, and mostly far less.
PARTITION_TERMS = 1 << 24

_is_term = [chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if _is_term[b] else 32 for b in range(256))

SEGMENTS = "term string, chunk long, n int, best int, rows binary, impacts binary, ids array<long>"


def terms_of(text: Column) -> Column:
    """All terms of a text in order."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0)


def counts_of(docs: DataFrame) -> tuple[int, int]:
    """N and L."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def tallied(text: bytes, known: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms, and how often each known one occurs."""
    total, found, at = 0, {}, 0
    text = text.translate(_FOLD)
    while at < len(text):
        end = len(text) if len(text) - at <= STRETCH else text.rfind(b" ", at, at + STRETCH)
        if end < 0:  # one term longer than a stretch
            end = text.find(b" ", at + STRETCH)
            end = len(text) if end < 0 else end
        words = Counter(text[at:end].split())
        total += words.total()
        for word in words.keys() & known.keys():
            found[known[word]] = found.get(known[word], 0) + words[word]
        at = end + (end == at)
    return total, found


class _Chunk:
    def __init__(self, terms: list[str], n_docs: int, n_terms: int):
        self.terms, self.docs, self.all = terms, n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.bytes = 0
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, doc_id, n: int, found: dict[int, int], size: int) -> bool:
        """True if the chunk is full."""
        if found:
            self.parts.append((len(self.ids), np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.int64, len(found))))
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.bytes += size
        return len(self.ids) >= CHUNK_DOCS or self.bytes >= CHUNK_BYTES

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        doc = np.repeat(np.array([i for i, _, _ in self.parts], np.int32), [len(t) for _, t, _ in self.parts])
        term, tf = (np.concatenate([p[j] for p in self.parts]) for j in (1, 2))
        m = 75 + (25 * np.array(self.lengths, np.int64) * self.docs) // self.all
        impact = ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])).astype(np.int32)
        order = np.lexsort((doc, -impact, term))
        doc, term, impact = doc[order], term[order], impact[order]
        start = np.concatenate(([0], np.nonzero(np.diff(term))[0] + 1, [len(term)]))
        spans = list(zip(start[:-1].tolist(), start[1:].tolist()))
        columns = [
            [None, *[self.terms[term[a]] for a, _ in spans]], [chunk] * (len(spans) + 1), [len(self.ids), *[b - a for a, b in spans]], [0, *[int(impact[a]) for a, _ in spans]],
            [b"", *[doc[a:b].tobytes() for a, b in spans]], [b"", *[impact[a:b].tobytes() for a, b in spans]], [self.ids, *[None] * len(spans)],
        ]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "chunk", "n", "best", "rows", "impacts", "ids"])
        self.clear()


def posting_segments(docs: DataFrame, terms: list[str], n_docs: int, n_terms: int) -> DataFrame:
    """SEGMENTS of (doc_id, text): the segments of the terms' lists, and for each chunk a row without term with its ids."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t.encode(): i for i, t in enumerate(sent.value)}
        chunk, number = _Chunk(sent.value, n_docs, n_terms), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            for i, doc_id in enumerate(ids):
                text = texts[i].as_py() or b""
                n, found = tallied(text, known)
                if chunk.add(doc_id, n, found, len(text)):
                    yield from chunk.rows(number)
                    number += 1
        yield from chunk.rows(number)

    return docs.mapInArrow(write, SEGMENTS)


def _entries(segment: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(segment["rows"], np.int32), np.frombuffer(segment["impacts"], np.int32)


class Asked:
    """The lists of a block of queries: which queries ask a term, with which weight (w times its repeats)."""

    def __init__(self, lists: list[tuple[int, str, int]]):
        """lists: (query number, term, weight above 0)"""
        self.by_query: dict[int, list[tuple[str, int]]] = {}
        for query, term, weight in lists:
            self.by_query.setdefault(query, []).append((term, weight))
        self.least: dict[int, int] = {}
        self.best: dict[str, int] = {}
        self.first: dict[int, int] = {}

    def bounded(self, first: dict[int, int], best: dict[str, int]) -> Asked:
        """With the first threshold of each query and the best impact of each list."""
        self.first, self.best = first, best
        self.least = {q: max(1, -(-first.get(q, 0) // len(lists))) for q, lists in self.by_query.items()}
        return self

    def cuts(self) -> dict[str, int]:
        """The least impact of a list that some query asks for."""
        cuts: dict[str, int] = {}
        for query, lists in self.by_query.items():
            for term, weight in lists:
                cut = -(-self.least[query] // weight)
                cuts[term] = min(cuts.get(term, cut), cut)
        return cuts


def _heads(lists: DataFrame, k: int) -> DataFrame:
    """term, doc (chunk and row), impact: the k best of each list."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s in batch.to_pylist():
                rows, impacts = _entries(s)
                own = np.full(min(k, len(rows)), s["chunk"]), rows[:k], impacts[:k]
                if s["term"] in kept:
                    both = [np.concatenate(pair) for pair in zip(kept[s["term"]], own)]
                    best = np.argsort(-both[2], kind="stable")[:k]
                    own = tuple(c[best] for c in both)
                kept[s["term"]] = own
        for term, (chunk, row, impact) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([term] * len(row), pa.string()), pa.array(chunk, pa.int64()), pa.array(row, pa.int32()), pa.array(impact, pa.int64())], ["term", "chunk", "row", "impact"])

    each = lists.select("term", "chunk", "rows", "impacts").mapInArrow(merge, "term string, chunk long, row int, impact long")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.col("impact").desc(), "chunk", "row"))
    return each.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _kth(scores: DataFrame, k: int) -> dict[int, int]:
    """query -> its k-th best ``score``, of those that have as many."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    return {r["query"]: r["score"] for r in scores.withColumn("_rank", rank).where(F.col("_rank") == k).select("query", "score").collect()}  # one row a query of the block


CANDIDATES = "chunk long, query int, rows binary, lower binary, upper binary"


def _bounded(lists: DataFrame, asked: Asked, k: int) -> DataFrame:
    """CANDIDATES: of every chunk and query the documents that may be among the k best, with their bounds."""
    spark = lists.sparkSession
    sent = spark.sparkContext.broadcast(asked)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value.cuts()
        for batch in batches:
            out: list[tuple] = []
            for s in batch.to_pylist():
                rows, impacts = _entries(s)
                n = int(np.searchsorted(-impacts, -cuts[s["term"]], side="right")) if s["term"] in cuts else 0
                if n:
                    out.append((s["chunk"], s["term"], rows[:n].tobytes(), impacts[:n].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["chunk", "term", "rows", "impacts"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        own, chunk = sent.value, key[0].as_py()
        segments = {s["term"]: _entries(s) for s in table.to_pylist()}  # of one chunk
        size = 1 + max(int(rows.max()) for rows, _ in segments.values())
        out = []
        for query, lists in own.by_query.items():
            least, floor = own.least[query], max(1, own.first.get(query, 0))
            rest = [min(least - 1, own.best[t] * w) for t, w in lists]
            here = [(segments[t], w, r) for (t, w), r in zip(lists, rest) if t in segments]
            most = sum(max(r, int(impacts[0]) * w) for (_, impacts), w, r in here) + sum(r for (t, _), r in zip(lists, rest) if t not in segments)
            if most < floor:
                continue
            lower, unseen = np.zeros(size, np.int64), np.full(size, sum(rest), np.int64)
            for (rows, impacts), w, r in here:
                n = int(np.searchsorted(-impacts, -(-(-least // w)), side="right"))
                lower[rows[:n]] += w * impacts[:n].astype(np.int64)
                unseen[rows[:n]] -= r
            upper = np.where(lower > 0, lower + unseen, 0)
            if (lower > 0).sum() >= k:
                floor = max(floor, int(np.partition(lower, -k)[-k]))
            rows = np.nonzero(upper >= floor)[0]
            if len(rows):
                out.append((chunk, query, rows.astype(np.int32).tobytes(), lower[rows].tobytes(), upper[rows].tobytes()))
        return pa.Table.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["chunk", "query", "rows", "lower", "upper"])

    fetched = lists.select("term", "chunk", "rows", "impacts").mapInArrow(fetch, "chunk long, term string, rows binary, impacts binary")
    return fetched.groupBy("chunk").applyInArrow(meet, CANDIDATES)


def _best_lower(candidates: DataFrame, first: dict[int, int], k: int) -> DataFrame:
    """query, score: lower bounds that may be among the k best, at most k of a query and task."""
    sent = candidates.sparkSession.sparkContext.broadcast(first)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for c in batch.select(["query", "lower"]).to_pylist():
                lower = np.frombuffer(c["lower"], np.int64)
                both = np.concatenate((kept.get(c["query"], lower[:0]), lower[lower >= max(1, sent.value.get(c["query"], 0))]))
                kept[c["query"]] = -np.sort(-both)[:k]
        for query, lower in kept.items():
            if len(lower):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(lower), pa.int32()), pa.array(lower)], ["query", "score"])

    return candidates.select("query", "lower").mapInArrow(best, "query int, score long")


def _looked_up(segments: DataFrame, candidates: DataFrame, asked: Asked, second: dict[int, int], k: int) -> DataFrame:
    """query, doc_id, score: of every chunk the k best documents of a query, exactly scored."""
    sent = segments.sparkSession.sparkContext.broadcast((asked, second))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                rows = np.frombuffer(c["rows"], np.int32)[np.frombuffer(c["upper"], np.int64) >= max(1, sent.value[1].get(c["query"], 0))]
                if len(rows):
                    out.append((c["chunk"], c["query"], rows.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], ["chunk", "query", "rows"])

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own, second = sent.value
        ids, by_term = None, {}
        for s in right.to_pylist():  # the segments of one chunk
            if s["term"] is None:
                ids = s["ids"]
            else:
                by_term[s["term"]] = _entries(s)
        number = np.array([i or 0 for i in ids], np.int64)
        missing = np.array([i is None for i in ids])
        out = []
        for c in left.to_pylist():
            exact, rows = np.zeros(len(ids), np.int64), np.frombuffer(c["rows"], np.int32)
            for term, w in own.by_query[c["query"]]:
                if term in by_term:
                    exact[by_term[term][0]] += w * by_term[term][1].astype(np.int64)
            keep = rows[exact[rows] >= max(1, second.get(c["query"], 0))]
            best = keep[np.lexsort((number[keep], missing[keep], -exact[keep]))[:k]]
            out += [(c["query"], ids[r], int(exact[r])) for r in best.tolist()]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    asking = stored(candidates.select("chunk", "query", "rows", "upper").mapInArrow(narrow, "chunk long, query int, rows binary"), "tput-asking")
    chunks = asking.select("chunk").distinct()
    near = segments.select("term", "chunk", "rows", "impacts", "ids").join(chunks, "chunk", "left_semi")
    return asking.groupBy("chunk").cogroup(near.groupBy("chunk")).applyInArrow(score, "query int, doc_id long, score long")


def _searched(docs: DataFrame, wanted: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, doc_id, score, rank of one block of (query, term, times)."""
    terms = sorted(r["term"] for r in wanted.select("term").distinct().collect())  # at most block_terms
    by_chunk = stored(posting_segments(docs, terms, n_docs, n_terms), "tput-chunks")  # so that a lost task cannot deal rows to other chunks
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_terms // PARTITION_TERMS))
    segments = stored(by_chunk.repartition(partitions, "term", "chunk").sortWithinPartitions("term", "chunk"), "tput-segments")
    forget(by_chunk)
    lists = segments.where("term IS NOT NULL")
    facts = lists.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"), F.max("best").alias("best"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    rows = wanted.join(F.broadcast(facts), "term").select("query", "term", "best", (weight * F.col("times")).alias("weight")).where("weight > 0").collect()  # at most block_terms
    asked = Asked([(r["query"], r["term"], r["weight"]) for r in rows])
    known = docs.sparkSession.createDataFrame([(r["query"], r["term"], r["weight"]) for r in rows], "query int, term string, weight long")
    heads = _heads(lists, k).join(F.broadcast(known), "term").groupBy("query", "chunk", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    first = _kth(heads.select("query", "score"), k)
    asked.bounded(first, {r["term"]: r["best"] for r in rows})
    candidates = stored(_bounded(lists, asked, k), "tput-candidates")
    second = {q: max(first.get(q, 0), s) for q, s in _kth(_best_lower(candidates, first, k), k).items()}
    found = _looked_up(segments, candidates, asked, first | second, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    out = stored(found.withColumn("rank", rank).where(F.col("rank") <= k), "tput-found")
    for table in (segments, candidates):
        forget(table)
    return out


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 20, block_terms: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_docs, n_terms = counts_of(own)
    asks = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("t")).groupBy("item_id").agg(F.min("t").alias("t"))
    each = asks.select("item_id", F.explode(terms_of(F.col("t"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    numbered = stored(each.select(F.xxhash64(F.lit(7), "item_id").alias("hash"), "item_id", "term", "times"), "tput-terms")
    size = numbered.count()
    blocks, path = max(1, -(-size // block_terms)), new_path(spark, "tput-ranked")
    for b in range(blocks):
        block = numbered.where(F.pmod("hash", F.lit(blocks)) == b)
        names = [(i, r["item_id"]) for i, r in enumerate(block.select("item_id").distinct().collect())]  # the queries of one block
        queries = spark.createDataFrame(names, StructType([StructField("query", IntegerType()), StructField("item", items.schema[item_id].dataType)]))
        wanted = block.join(F.broadcast(queries), F.col("item_id").eqNullSafe(F.col("item"))).select("query", "term", "times")
        found = _searched(own, stored(wanted, "tput-wanted"), n_docs, n_terms, k).join(F.broadcast(queries), "query")
        found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score").schema).parquet(path)
