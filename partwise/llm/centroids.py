"""Lloyd's clustering of integer vectors: float32 screening, exact integers where it cannot decide.

Components become integers ``floor(scale * x)``. To find a vector's nearest
centroid, ``|c|^2 - 2 x.c`` is estimated for all centroids with one float32
matrix product, and each estimate gets an interval that surely holds the true
value: for ``d`` components the computed product is off by at most
``g |x| |c|``, ``g = (d + 2) u / (1 - (d + 2) u)``, ``u = 2^-24``, whatever the order of
summation (two of the roundings are those of the inputs). A centroid whose
interval begins above the least end of all intervals cannot be nearest. Where
more than one is left, those are recomputed with exact integers, ties to the
lower number. Values that don't fit float32 leave all centroids in.

The vectors are read once and stored as integers. A round is one pass over that
table with the centroids broadcast (``k`` vectors); each task adds up its vectors
by cluster and returns the sums in limbs of 32 bits, which Spark adds up, so
that sums stay exact at any size and the driver gets ``k (d + 1)`` of them. When
no centroid moves the rounds end, as all further ones would be equal.

Defined cases: vectors that are null, of another length or that hold a null or
non-finite component take no part; a null id takes part but becomes a first
centroid only if there are too few others; rows that repeat count as often as
they occur, and those of one id are ordered by components where they become
centroids; with fewer than ``k`` vectors there are as many centroids; empty
clusters keep their centroid; distances and their sums beyond 64 bits are
clipped; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components below this are stored as 32-bit integers; a vector with a larger one as decimal numbers in a string.
NARROW = 2**31
#: Exact distances fit 64-bit integers while |x| + |c| stays below this, for up to 128 components.
SAFE = 2**28
MOST = 2**63 - 1
KEPT = "id long, x array<int>, wide string"


def _whole(x: float, scale: float) -> int:
    y = scale * x
    return math.floor(y) if math.isfinite(y) else math.floor(Fraction(scale) * Fraction(x))


def _integers(batches: Iterator[pa.RecordBatch], size: int, scale: float) -> Iterator[pa.RecordBatch]:
    """The valid vectors of (id, v) as integers."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        lengths = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        values = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), dtype=np.float64)
        start = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        rows = np.nonzero(np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False)) & (lengths == size))[0]
        x = values[start[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1)
        rows, x = rows[good], x[good]
        with np.errstate(over="ignore"):
            whole = np.floor(scale * x)
        fits = (np.abs(whole) < NARROW).all(axis=1)
        for at in (np.nonzero(fits)[0], np.nonzero(~fits)[0]):
            if len(at):
                own = ids.take(pa.array(rows[at]))
                if fits[at[0]]:
                    flat = pa.array(whole[at].astype(np.int32).ravel())
                    narrow, wide = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), flat), pa.nulls(len(at), pa.string())
                else:
                    narrow, wide = pa.nulls(len(at), pa.list_(pa.int32())), pa.array([",".join(str(_whole(v, scale)) for v in row) for row in x[at].tolist()])
                yield pa.RecordBatch.from_arrays([own, narrow, wide], ["id", "x", "wide"])


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, integer vectors): int64 for those stored as such, Python integers for the rest."""
    narrow = np.asarray(batch.column("x").is_valid().to_numpy(zero_copy_only=False))
    at = np.nonzero(narrow)[0]
    if len(at):
        yield at, np.asarray(batch.column("x").flatten()).reshape(len(at), -1).astype(np.int64)
    at = np.nonzero(~narrow)[0]
    if len(at):
        texts = batch.column("wide").take(pa.array(at)).to_pylist()
        yield at, np.array([[int(v) for v in t.split(",")] for t in texts], dtype=object)


def _floats(numbers: np.ndarray) -> np.ndarray:
    def one(v: int) -> float:
        try:
            return float(v)
        except OverflowError:
            return math.inf if v > 0 else -math.inf

    return numbers.astype(np.float64) if numbers.dtype != object else np.array([one(v) for v in numbers.ravel()], dtype=np.float64).reshape(numbers.shape)


class Centroids:
    """Numbered integer vectors and the nearest of them."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors = vectors
        self.most = max((abs(v) for c in vectors for v in c), default=0)
        self.exact = np.array(vectors, dtype=np.int64 if self.most < 2**62 else object).reshape(len(vectors), len(vectors[0]) if vectors else 0)
        self.squares = _floats(np.array([sum(v * v for v in c) for c in vectors], dtype=object))
        floats = _floats(self.exact)
        with np.errstate(over="ignore"):
            self.rough, self.norms = floats.astype(np.float32), np.sqrt((floats**2).sum(axis=1)) * (1 + 1e-12)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """For each vector which centroids may be nearest."""
        n, unit = x.shape[1] + 2, 2.0**-24
        floats = _floats(x)
        with np.errstate(over="ignore", invalid="ignore"):
            product = (floats.astype(np.float32) @ self.rough.T).astype(np.float64)
            length = np.sqrt((floats**2).sum(axis=1)) * (1 + 1e-12)
            off = 2 * (n * unit / (1 - n * unit)) * np.multiply.outer(length, self.norms)
            value = self.squares - 2 * product
            off += 2.0**-49 * (self.squares + 2 * np.abs(product) + off)  # of the double precision work above
            low, high = value - off, value + off
            unknown = ~(np.isfinite(low) & np.isfinite(high)).all(axis=1)
            may = low <= high.min(axis=1)[:, None]
        may[unknown] = True
        return may

    def distances(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to the centroid of its number."""
        if x.dtype != object and x.shape[1] <= 128 and int(np.abs(x).max(initial=0)) + self.most < SAFE:
            return ((x - self.exact[numbers]) ** 2).sum(axis=1)
        return ((x.astype(object) - self.exact[numbers].astype(object)) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
        """The number of each vector's nearest centroid, the lower one of equals."""
        step = max(1, at_once // max(1, len(self.vectors)))
        return np.concatenate([self._nearest(x[at : at + step]) for at in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        may = self.shortlist(x)
        found = may.argmax(axis=1)
        open_rows = np.nonzero(may.sum(axis=1) > 1)[0]
        row, number = np.nonzero(may[open_rows])  # by row, then by number
        best: dict[int, tuple[int, int]] = {}
        for at in range(0, len(row), 1 << 16):
            far = self.distances(x[open_rows[row[at : at + (1 << 16)]]], number[at : at + (1 << 16)])
            for r, c, d in zip(row[at : at + (1 << 16)].tolist(), number[at : at + (1 << 16)].tolist(), far.tolist()):
                if r not in best or d < best[r][0]:  # of equals the lower number came first
                    best[r] = d, c
        for r, (_, c) in best.items():
            found[open_rows[r]] = c
        return found


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, i = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & 0xFFFFFFFF:
            yield i, sign * (value & 0xFFFFFFFF)
        value, i = value >> 32, i + 1


def _sums(table: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """number -> (count, sum of its vectors) of the non-empty clusters."""
    sent = table.sparkSession.sparkContext.broadcast(centroids)
    size = centroids.exact.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, {}
        for batch in batches:
            for _, x in _vectors(batch):
                numbers = own.nearest(x)
                for c in np.unique(numbers).tolist():
                    mine = x[numbers == c]
                    count, old = total.get(c, (0, [0] * size))
                    total[c] = count + len(mine), [a + int(b) for a, b in zip(old, mine.sum(axis=0).tolist())]
        rows = [(c, p, i, v) for c, (count, vector) in total.items() for p, value in [(-1, count), *enumerate(vector)] for i, v in _limbs(value)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "place", "limb", "part"])

    found: dict[int, tuple[int, list[int]]] = {}
    added = table.mapInArrow(add, "cluster int, place int, limb int, part long").groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part"))
    for c, p, i, part in added.collect():  # k (d + 1) sums of a few limbs
        count, vector = found.get(c, (0, [0] * size))
        if p < 0:
            count += part << 32 * i
        else:
            vector[p] += part << 32 * i
        found[c] = count, vector
    sent.destroy()
    return found


def first_centroids(table: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = table.orderBy(digest.asc_nulls_last(), "x", "wide").limit(k).collect()  # k rows
    return [list(r["x"]) if r["x"] is not None else [int(v) for v in r["wide"].split(",")] for r in rows]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: float = 1024.0, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    table = stored(rows.mapInArrow(lambda batches: _integers(batches, size, scale), KEPT), "centroid-vectors")
    centroids = Centroids(first_centroids(table, k, seed))
    for _ in range(rounds if centroids.vectors else 0):
        sums = _sums(table, centroids)
        moved = [[v // sums[c][0] for v in sums[c][1]] if c in sums else old for c, old in enumerate(centroids.vectors)]
        if moved == centroids.vectors:
            break
        centroids = Centroids(moved)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch):
                numbers = sent.value.nearest(x)
                far = sent.value.distances(x, numbers)
                clipped = far if far.dtype != object else np.array([min(v, MOST) for v in far], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(numbers, pa.int32()), pa.array(clipped, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stored(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "centroid-assigned")
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    facts = [(c, min(sums.get(c, 0), MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.vectors)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
