"""Exact top-k inner-product search with pivot elimination.

Vectors are turned into integers ``floor(scale * x)``. For a pivot ``p`` the
triangle inequality gives ``|q - x| >= |d(q,p) - d(x,p)|``; the largest such
bound over all pivots turns into an upper bound of the inner product,
``(|q|^2 + |x|^2 - bound^2) / 2``. Candidates are evaluated in the order of
that bound until it falls below the k-th best score.

Pivots come from a bounded sample of rows (``sample``). The distances of all rows
to them are computed once and stored with the vectors; so are the queries, each
with a first threshold, its k-th best score in the sample. Both only prune, the
result is exact. Queries go in blocks of bounded bytes (``block_bytes``), each
sent to all partitions of the stored table; a partition returns its k best for a
query, and a ranked window merges them. With several blocks each one's results
are stored, so the plan stays of one size.

Defined cases: null vectors, vectors with null or non-finite components and
rows without id take no part; vectors of unlike lengths are never compared; a
query id that occurs in several rows asks with its smallest vector; rows with
the query's id are not its candidates; any other repeated row counts as often
as it occurs; ties go to the smaller id; other columns are ignored; an empty table
gives an empty result. Scores beyond 64 bits are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stored


def _vectors(ids: pa.Array, vectors: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors as float64) of the valid rows, one pair for each length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(ids)
    if not n:
        return []
    lengths = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = vectors.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), dtype=np.float64)
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    ok = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False)) & np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False))
    numbers = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out = []
    for size in np.unique(lengths[ok]):
        rows = np.nonzero(ok & (lengths == size))[0]
        x = values[start[rows][:, None] + np.arange(size)] if size else np.zeros((len(rows), 0))
        finite = np.isfinite(x).all(axis=1)
        out.append((numbers[rows][finite], np.floor(scale * x[finite])))
    return [(i, x) for i, x in out if len(i)]


def _far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Pivots: the vector farthest from those already chosen, again and again."""
    chosen, near = [0], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with q."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if top < 2**53:
        return (x @ q).astype(np.int64)
    if top < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in exact], dtype=np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Block:
    """A block of queries of one vector length, with their distances to the pivots and first thresholds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.to_pivots, self.floor, self.k = ids, vectors, to_pivots, floor, k
        self.norms = (vectors**2).sum(1)

    def search(self, found: dict, ids: np.ndarray, x: np.ndarray, to_pivots: np.ndarray, step: int = 512, at_once: int = 128) -> None:
        """Update ``found`` (query row -> ids, scores) with the candidates ``x``."""
        norms = (x**2).sum(1)
        for lo in range(0, len(self.ids), at_once):
            part = slice(lo, lo + at_once)
            bound = np.zeros((len(self.ids[part]), len(ids)))
            for p in range(to_pivots.shape[1]):
                np.maximum(bound, np.abs(np.subtract.outer(self.to_pivots[part, p], to_pivots[:, p])), out=bound)
            most = np.add.outer(self.norms[part], norms)
            slack = 1 + 1e-9 * most  # rounding never lowers an upper bound
            most = (most - bound**2) / 2 + slack
            for j in range(len(bound)):
                i = lo + j
                own_ids, own = found.get(i, (np.empty(0, np.int64), np.empty(0, np.int64)))
                least = max(self.floor[i], own[-1] if len(own) == self.k else -np.inf)
                rows = np.nonzero((most[j] >= least) & (ids != self.ids[i]))[0]
                rows = rows[np.argsort(-most[j][rows], kind="stable")]
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    if most[j][some[0]] < least:
                        break
                    got = _scores(x[some], self.q[i])
                    keep = got >= least
                    own_ids, own = _best(np.concatenate((own_ids, ids[some][keep])), np.concatenate((own, got[keep])), self.k)
                    least = max(least, own[-1] if len(own) == self.k else -np.inf)
                found[i] = own_ids, own


MEASURED = "id long, d int, x binary, dist binary, floor double"


def _measured(rows: DataFrame, pivots: dict[int, np.ndarray], scale: float, sample: dict[int, tuple[np.ndarray, np.ndarray]] | None, k: int) -> DataFrame:
    """Valid vectors of (id, v) as numbers with their distances to the pivots of their length; with a ``sample`` also the k-th best score in it."""
    sent = rows.sparkSession.sparkContext.broadcast((pivots, sample))  # bounded by the sample

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, drawn = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for ids, x in _vectors(part.column(0), part.column(1), scale):
                    dist = _distances(x, own.get(x.shape[1], np.zeros((0, x.shape[1]))))
                    floor = np.full(len(ids), -np.inf)
                    if drawn is not None and x.shape[1] in drawn:
                        other_ids, other = drawn[x.shape[1]]
                        for i in range(len(ids)):
                            scores = _scores(other, x[i])[other_ids != ids[i]]
                            if len(scores) >= k:
                                floor[i] = np.partition(scores, -k)[-k]
                    columns = [pa.array(ids), pa.array(np.full(len(ids), x.shape[1], np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in dist], pa.binary()), pa.array(floor)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "d", "x", "dist", "floor"])

    return rows.mapInArrow(measure, MEASURED)


def _unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, vectors, distances, floors) for each vector length of a batch of measured rows."""
    d, ids, floor = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch.column(c), pa.Array) else batch.column(c).to_numpy()) for c in ("d", "id", "floor"))
    x, dist = batch.column("x").to_pylist(), batch.column("dist").to_pylist()
    for size in np.unique(d):
        at = np.nonzero(d == size)[0]
        yield ids[at], *(np.frombuffer(b"".join(c[i] for i in at)).reshape(len(at), -1) if size or c is dist else np.zeros((len(at), 0)) for c in (x, dist)), floor[at]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int = 32, sample: int = 2048, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    drawn = {x.shape[1]: (i, x) for i, x in _vectors(*_columns(rows.orderBy(F.xxhash64("id"), "id").limit(sample)), scale)}
    chosen = {d: _far_apart(x, pivots) for d, (_, x) in drawn.items()}
    table = stored(_measured(rows, chosen, scale, None, k), "pivot-table")
    valid = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    asked = rows.where(is_query & F.col("id").isNotNull() & valid).groupBy("id").agg(F.min("v").alias("v"))
    queries = stored(_measured(asked, chosen, scale, drawn, k), "pivot-queries")
    size = queries.agg(F.coalesce(F.sum(F.length("x") + F.length("dist")), F.lit(0))).first()[0]
    blocks, path, out = max(1, -(-size // block_bytes)), new_path(spark, "pivot-found"), None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(F.lit(b"block"), F.col("id")), F.lit(blocks)) == b).toArrow()  # about block_bytes
        sent = spark.sparkContext.broadcast([Block(i, x, dist, floor, k) for i, x, dist, floor in _unpacked(own)])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found: list[dict] = [{} for _ in sent.value]
            for batch in batches:
                for ids, x, dist, _ in _unpacked(batch):
                    for own, block in zip(found, sent.value):
                        if block.q.shape[1] == x.shape[1]:
                            block.search(own, ids, x, dist)
            for own, block in zip(found, sent.value):
                for i, (ids, scores) in own.items():
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block.ids[i])), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        out = table.mapInArrow(search, "query_id long, vec_id long, score long")
        if blocks > 1:
            out.write.mode("append").parquet(path)
    parts = out if blocks == 1 else spark.read.schema(out.schema).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _columns(df: DataFrame) -> tuple[pa.Array, pa.Array]:
    table = df.toArrow()
    ids, vectors = table.column(0), table.column(1)
    return ids.combine_chunks(), vectors.combine_chunks()
