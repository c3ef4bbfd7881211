"""Legacy ARC archives to WARC.

An ARC file starts with a version block whose first line is a record header and
whose second names the version: version 1 headers have five fields, version 2
headers ten; both end in the declared length of what follows. The converter
parses every record by that length and synthesises the WARC equivalents:
record ids (from digest and page id), timestamps (14 digits to ISO 8601),
record types and SHA-256 digests. Payloads of ``min_revisit`` bytes or more
that occur before (smallest page id first) become revisit records.

Archives are gzipped files of at most ``PER_FILE`` segments. A segment holds whole
records of ``SEGMENT`` bytes together, or a single larger one, so files are bounded
by bytes, not by rows; they are read as a stream, record by record. Spark's text
writer writes them with the record separator as line separator (the separator is
the one that the formats ask for) and the ``binaryFile`` source reads them, so
any file system that Spark reaches will do.

Defined cases: a null payload is empty; a null URL becomes
``http://unknown.invalid/``; white space in URLs is percent-encoded; records
without page id come last among equals; equal rows with one page id give one
response and revisits to the same id; other columns are ignored; an empty table
gives empty archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, salted_lookup, stored

MIN_REVISIT = 100
#: Bytes of whole records that are written together, and how many such segments a file has.
SEGMENT, PER_FILE = 4 << 20, 32
#: Rows that a reading task hands over together.
ROWS = 4096
#: Revisit records up to which their table (three numbers each) is broadcast to the archives; beyond it the archives are shuffled once.
BROADCAST_REVISITS = 1_000_000
#: Fields of record headers by ARC version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _write(records: DataFrame, path: str, separator: str) -> None:
    """Write the segments of the ``record`` column, bytes as they are, ``separator`` after each."""
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", separator)
        .option("maxRecordsPerFile", PER_FILE)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _stream(content: bytes | pa.Buffer) -> io.BufferedIOBase:
    raw = pa.BufferReader(content)
    return gzip.GzipFile(fileobj=raw) if bytes(memoryview(content)[:2]) == b"\x1f\x8b" else io.BufferedReader(raw)


class Segments:
    """Whole records of one task, gathered into rows of about ``SEGMENT`` bytes."""

    def __init__(self, separator: bytes, first):
        self.separator, self.first, self.n = separator, first, 0
        self.held, self.size = [], 0

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        if self.held and self.size + len(record) > SEGMENT:
            yield from self.flush()
        if not self.held and self.n % PER_FILE == 0:  # a new file begins
            self.held.append(self.first(self.n // PER_FILE))
        self.held.append(record)
        self.size += len(record)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array([self.separator.join(self.held)], pa.binary())], ["record"])
            self.held, self.size, self.n = [], 0, self.n + 1


def _rows(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(kinds)], names)


def _arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 partwise\n{' '.join(FIELDS[version])}\n"
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n{body}".encode()


def write_arc(pages: DataFrame, path: str, page_id="page_id", url="url", html="html", date: str = "20240101000000") -> None:
    """Write pages as ARC files, versions 1 and 2 in turn by partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        out = Segments(b"\n", lambda n: _arc_version_block(version, f"part-{part}-{n}.arc", date))
        for batch in batches:
            for key, address, html_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                payload = html_.as_py() or b""
                own = f"X-Page-Id: {key}\r\n" if key is not None else ""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()
                where = quote(address, safe="%/:=&?~#+!$,;'@()*[]") if address else "http://unknown.invalid/"
                extra = f" 200 - - 0 part-{part}.arc" if version == 2 else ""
                head = f"{where} 0.0.0.0 {date} text/html{extra} {len(http) + len(payload)}\n".encode()
                yield from out.add(b"".join((head, http, payload)))
        yield from out.flush()

    rows = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.encode(F.col(html).cast("string"), "UTF-8"))
    _write(rows.mapInArrow(build, "record binary"), path, "\n")


def arc_records(content: bytes | pa.Buffer) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record of an ARC file."""
    data, version = _stream(content), None
    while line := data.readline():
        line = line.rstrip(b"\n")
        if not line.strip():
            continue
        if version is None:
            version = int(data.read(int(line.rsplit(b" ", 1)[1])).split(b" ", 1)[0])
            continue
        values = line.rsplit(b" ", len(FIELDS[version]) - 1)
        if len(values) != len(FIELDS[version]):
            raise ValueError(f"an ARC {version} record header has {len(values)} fields")
        block = data.read(int(values[-1]))
        if len(block) < int(values[-1]):
            raise ValueError("an ARC record is shorter than declared")
        yield dict(zip(FIELDS[version], (v.decode("latin-1") for v in values))), block


def _http(block: bytes) -> tuple[dict[str, str], int]:
    """HTTP headers and where the payload starts."""
    end = block.find(b"\r\n\r\n")
    cut = len(block) if end < 0 else end + 4
    fields = (line.partition(b":") for line in block[:cut].split(b"\r\n")[1:] if line)
    return {k.decode("latin-1").lower(): v.strip().decode("latin-1") for k, _, v in fields}, cut


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per ARC record without its payload."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            records = ((n, block, *_http(block)) for n, (_, block) in enumerate(arc_records(content.as_buffer())))
            rows = ((path, n, _number(headers.get("x-page-id")), hashlib.sha256(memoryview(block)[cut:]).digest(), len(block) - cut) for n, block, headers, cut in records)
            yield from _rows(rows, ["path", "n", "page_id", "digest", "bytes"], kinds)


def _revisits(records: DataFrame, min_revisit: int) -> DataFrame:
    """(path, again): the records of a file that revisit an earlier response, with that response's page id.

    The groups of equal payloads are pre-aggregated; the way back to the
    records is a salted join, so a payload that a third of the pages share
    spreads over the salts. A file has a bounded number of records.
    """
    own = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "path", "n")
    large = records.where(F.col("bytes") >= min_revisit).withColumn("own", own)
    first = large.groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("times")).where(F.col("times") > 1).drop("times")
    again = salted_lookup(large, first, "digest", F.struct("path", "n"), how="inner").where(F.col("own") != F.col("first"))
    return again.groupBy("path").agg(F.collect_list(F.struct("n", F.col("first.page_id").alias("refers_to"))).alias("again"))


def _warc_record(kind: str, date: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", date), *fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _convert(min_revisit: int):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, date = TaskContext.get().partitionId(), ["19700101000000"]
        info = lambda n: _warc_record("warcinfo", _iso(date[0]), b"software: partwise\r\n", [("WARC-Record-ID", _urn("info", part, n)), ("Content-Type", "application/warc-fields")])
        out = Segments(b"\r\n\r\n", info)
        for batch in batches:
            for path, content, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                refers = {x["n"]: x["refers_to"] for x in again or ()}
                for i, (arc, block) in enumerate(arc_records(content.as_buffer())):
                    date[0] = arc["Archive-date"]
                    headers, cut = _http(block)
                    page, digest = headers.get("x-page-id"), hashlib.sha256(memoryview(block)[cut:]).hexdigest()
                    fields = [("WARC-Target-URI", arc["URL"]), ("WARC-IP-Address", arc["IP-address"]), ("WARC-Payload-Digest", "sha256:" + digest), ("Content-Type", "application/http; msgtype=response")]
                    if i in refers:
                        first = refers[i]
                        fields += [("WARC-Record-ID", _urn("revisit", path, i)), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn("response", digest, first))]
                        fields += [("X-Refers-To-Page-Id", str(first))] * (first is not None)
                        yield from out.add(_warc_record("revisit", _iso(date[0]), block[:cut], fields))
                    else:
                        alone = len(block) - cut < min_revisit
                        fields.append(("WARC-Record-ID", _urn("small", path, i) if alone else _urn("response", digest, _number(page))))
                        yield from out.add(_warc_record("response", _iso(date[0]), block, fields))
        yield from out.flush()

    return convert


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Convert the ARC files under ``arc_path`` to WARC files under ``warc_path``."""
    records = stored(_files(spark, arc_path).mapInArrow(_describe, "path string, n int, page_id long, digest binary, bytes long"), "arc-records")
    again = stored(_revisits(records, min_revisit), "arc-revisits")
    few = (again.agg(F.sum(F.size("again"))).first()[0] or 0) <= BROADCAST_REVISITS
    todo = _files(spark, arc_path).join(F.broadcast(again) if few else again.hint("merge"), "path", "left")
    _write(todo.mapInArrow(_convert(min_revisit), "record binary"), warc_path, "\r\n\r\n")


def warc_records(content: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file."""
    data = _stream(content)
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = data.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a WARC record is shorter than declared")
        yield fields, block
        data.read(4)


def _page(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["warc-type"]
    headers, cut = _http(block)
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(memoryview(block)[cut:]).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    size = len(block) - cut if kind == "response" else int(headers["content-length"])
    return _number(headers.get("x-page-id")), fields["warc-target-uri"], size, digest, kind, _number(fields.get("x-refers-to-page-id")), fields["warc-record-id"], fields["warc-date"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for content in batch.column(1):
            yield from _rows((_page(*r) for r in warc_records(content.as_buffer()) if r[0]["warc-type"] != "warcinfo"), names, kinds)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record; response payloads are checked against their digests."""
    return _files(spark, path).mapInArrow(_read, "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string")


def through_archives(pages: DataFrame, **names: str) -> DataFrame:
    """Pages to ARC files, ARC to WARC, and the WARC files read back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, **names)
    convert_arc(spark, arc, warc)
    return read_warc(spark, warc)
