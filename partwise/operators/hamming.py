"""Nearest hashes by differing bits: a stated set of queries against all rows, in blocks.

A hash is a tuple of 64-bit or shorter numbers. The distinct hashes of a block of queries go to all partitions; a task
keeps the k best of each, and a ranked window merges them. Nothing is crossed: a task yields k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.operators.tables import stored

#: Hashes of a block; they are broadcast, and a task holds k candidates of 16 bytes for each.
BLOCK = 50_000


class _Best:
    """The k nearest of each query so far, by distance, then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.apart = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def take(self, ids: np.ndarray, hashes: np.ndarray, at_once: int = 256) -> None:
        order = np.argsort(ids, kind="stable")
        ids, hashes, place = ids[order], hashes[order], np.arange(len(ids))
        n = min(self.k, len(ids))
        for lo in range(0, len(self.queries), at_once):
            own = self.queries[lo : lo + at_once]
            apart = sum(np.bitwise_count(np.bitwise_xor.outer(own[:, c], hashes[:, c]).view(np.uint64)).astype(np.int64) for c in range(own.shape[1]))
            nearest = np.argpartition(apart * len(ids) + place, n - 1, axis=1)[:, :n]  # ties to the smaller id
            both = np.concatenate((self.apart[lo : lo + at_once], np.take_along_axis(apart, nearest, axis=1)), axis=1)
            named = np.concatenate((self.ids[lo : lo + at_once], ids[nearest]), axis=1)
            kept = np.lexsort((named, both), axis=1)[:, : self.k]
            self.apart[lo : lo + at_once], self.ids[lo : lo + at_once] = np.take_along_axis(both, kept, axis=1), np.take_along_axis(named, kept, axis=1)


def nearest_hashes(asked: DataFrame, rows: DataFrame, hashes: list[str], id_col: str, k: int) -> DataFrame:
    """(hashes, other, apart): for each distinct hash of ``asked`` the k rows of ``rows`` (id, hashes) with fewest differing bits, ties to the smaller id; null ids and hashes take no part."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in hashes)
    distinct = stored(asked.select(*hashes).where(whole).distinct(), "hash-queries")
    blocks, out = max(1, -(-distinct.count() // BLOCK)), None
    for b in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64(*hashes), F.lit(blocks)) == b).toArrow()  # about BLOCK rows
        queries = np.stack([own.column(c).to_numpy().astype(np.int64) for c in hashes], axis=1) if own.num_rows else np.empty((0, len(hashes)), np.int64)
        sent = asked.sparkSession.sparkContext.broadcast(queries)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = _Best(sent.value, k)
            for batch in batches:
                if batch.num_rows:
                    best.take(batch.column(0).to_numpy(), np.stack([batch.column(i + 1).to_numpy().astype(np.int64) for i in range(len(hashes))], axis=1))
            some = best.ids != np.iinfo(np.int64).max
            at = np.nonzero(some)[0]
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.array(best.queries[at, c]) for c in range(len(hashes))), pa.array(best.ids[some]), pa.array(best.apart[some])], [*hashes, "other", "apart"])

        schema = ", ".join(f"{c} long" for c in hashes) + ", other long, apart long"
        part = rows.where(whole).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), *hashes).mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    nth = F.row_number().over(Window.partitionBy(*hashes).orderBy("apart", "other"))
    return out.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
