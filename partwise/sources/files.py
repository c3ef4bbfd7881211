"""Digests of whole files of any size, read in pieces through Spark's own readers.

A SHA-256 digest takes the bytes of a file in order, so a file is the work of one
task; other files are other tasks'. The text source reads it as pieces that end
with ``MARK``: every page of a Parquet file begins with that byte (the first field
of its header), so no piece is longer than a page, whatever the file's size. What
was digested is held against the length that the listing gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"\x15"
#: The text source drops this at a file's start.
BYTE_ORDER = b"\xef\xbb\xbf"
#: Hadoop's codec that changes nothing; files of the suffix that it stands for are read by one task from start to end.
WHOLE = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
SUFFIX = "io.compress.passthrough.extension"
#: Its name in Hadoop's client library, where other libraries' names have this before them.
SHADED = f"org.apache.hadoop.shaded.{SUFFIX}"


def listing(spark: SparkSession, folder: str, kind: str, suffix: str):
    """A reader of the files of a folder and those below it with this suffix, for one of Spark's sources."""
    return spark.read.format(kind).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").options(**WHOLE, **{SUFFIX: suffix, SHADED: suffix})


class Digest:
    """The digest of a file from its pieces, each with its mark; whether the file ends with one is told by its length."""

    def __init__(self, file: str, size: int, start: bytes):
        self.file, self.size, self.seen, self.held = file, size, 0, b""
        # A Parquet file starts otherwise than with a mark of byte order; of other files one may have been dropped.
        self.sums = {skipped: hashlib.sha256(skipped) for skipped in ((b"",) if start == b"PAR1" else (b"", BYTE_ORDER))}

    def add(self, data: memoryview) -> None:
        for each in self.sums.values():
            each.update(self.held)
            each.update(data[:-1])
        self.seen, self.held = self.seen + len(data), bytes(data[-1:])

    def row(self) -> dict:
        for skipped, each in self.sums.items():
            for rest in (self.held, b""):
                if self.seen - len(self.held) + len(skipped) + len(rest) == self.size:
                    each.update(rest)
                    return {"file": self.file, "sha": each.hexdigest()}
        raise ValueError(f"{self.file} gave {self.seen} bytes of {self.size}")


def digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, sha) from (file, size, piece); the pieces of a file follow one another."""
    now, done = None, []
    for batch in batches:
        pieces = batch.column("piece").cast(pa.large_binary())
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, first = memoryview(pieces.buffers()[2]), 0
        for last in pc.run_end_encode(batch.column("file")).run_ends.to_pylist():
            file = batch.column("file")[first].as_py()
            if now is None or now.file != file:
                done += [now.row()] if now else []
                now = Digest(file, batch.column("size")[first].as_py(), bytes(data[ends[first] : ends[first] + 4]))
            now.add(data[ends[first] : ends[last]])
            first = last
        if done:
            yield pa.RecordBatch.from_pylist(done)
            done = []
    if now:
        yield pa.RecordBatch.from_pylist([now.row()])


def digested(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, length, sha) of the files of a folder and those below it with this suffix."""
    file = F.col("_metadata.file_path").alias("file")
    files = listing(spark, folder, "binaryFile", suffix).load(folder).select(file, "path", "length")
    piece = F.concat(F.col("value").cast("binary"), F.lit(MARK)).alias("piece")
    pieces = listing(spark, folder, "text", suffix).option("lineSep", MARK.decode()).load(folder).select(file, F.col("_metadata.file_size").alias("size"), piece)
    sums = pieces.mapInArrow(digest_pieces, "file string, sha string")
    bare = F.when(F.col("length") == len(BYTE_ORDER), hashlib.sha256(BYTE_ORDER).hexdigest())  # a file of these bytes alone has no piece
    return files.join(sums, "file", "left").select("path", "length", F.coalesce("sha", bare).alias("sha"))
