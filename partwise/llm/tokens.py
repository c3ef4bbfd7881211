"""Token ids of whole texts in canonical, length-limited Huffman code.

Texts are encoded with a public tokenizer file (its path is a parameter). The
counts of all ids give one canonical code whose lengths stay within
``MAX_LENGTH`` (package-merge), so that a code word is found by one look into a
table. Every document is one byte-aligned bit string, an independent block;
a checkpoint (bit offset) every ``STEP`` ids lets all stretches of a file be
decoded side by side.

File format, little-endian, one or more parts per file, each followed by a line
feed: ``HUF1``, then u32 header length, a JSON header (counts, maximum length),
u8 code lengths by id, i64 doc ids, u8 flags of null ids, u32 ids per document,
u32 bytes per document, u32 checkpoints, and the bit strings. Files and
parts are in ascending order of doc_id. A range of doc_id is one or more files
of at most ``PARTS`` parts, a part about ``PART_BYTES`` or a single longer document.

The files are written by Spark's text writer (bytes as they are) and read by the
``binaryFile`` source, so any file system that Spark reaches will do.

Defined cases: a null text is empty and has only the end id; null doc_ids come
first; equal doc_ids are kept, in the order of their ids' bytes; an empty table
gives no file. Special-token strings in texts are encoded as the library does.
Other columns are ignored. Ids must be below 65,536.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, new_path, remember_in, stored, use_memory

MAX_LENGTH = 16
STEP = 256
MAGIC = b"HUF1"
#: Words whose ids a worker process remembers; the memory is emptied when full.
REMEMBERED = 1_200_000
#: Longer words (in bytes or characters) aren't remembered, so the memory is bounded by bytes too.
LONG_WORD = 64
#: Bytes of ids that a range of doc_id holds about, bytes of a part (but for a single longer document), parts of a file.
RANGE_BYTES, PART_BYTES, PARTS = 32 << 20, 4 << 20, 32

_encoders: dict[str, _Words] = {}
LATIN = [chr(c) for c in range(0xC0, 0x100) if chr(c) not in "×÷"]
_plain_word = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str) -> _Words:
    """This process's memory of words for a tokenizer file, made once per worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders[path] = _Words(Tokenizer.from_file(path))
        remember_in("tokens", _encoders)
    return _encoders[path]


def _cuts_at_blanks(setup: dict) -> bool:
    """Whether the ids of a text are those of its words: the file drops white space and cuts at it, and has no other steps."""
    normal, before = setup["normalizer"] or {}, setup["pre_tokenizer"] or {}
    steps = normal.get("normalizers", []) if normal.get("type") == "Sequence" else [normal]
    kinds = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in steps]
    parts = before.get("pretokenizers", [])
    if kinds != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return False
    split, level = parts
    runs = split["pattern"].get("Regex", "").split("|")[-3:]
    return split["behavior"] == "Removed" and split["invert"] and runs == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] and not level["add_prefix_space"] and not level["use_regex"]


class _Words(dict):
    """Ids (as bytes) of the words that this process has met; new ones are encoded when asked for.

    Where the file's own steps cut at white space (``whole`` is false), a word of
    ASCII and Latin-1 letters with ASCII punctuation (no apostrophe) after them
    passes normalizer and pre-tokenizer as its lower-case letters and its
    punctuation, so the library's model is asked for these pieces, and each is
    remembered; any other word takes the whole way. Texts with a special token,
    and all texts of any other file, are encoded as a whole.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.pieces = tokenizer, tokenizer.model, {}
        self.whole = not _cuts_at_blanks(json.loads(tokenizer.to_str()))
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else None
        self.size = 0
        if not self.whole:
            self.letters = {ord(c): "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in LATIN}

    def __missing__(self, word: bytes) -> bytes:
        m = _plain_word.match(text := word.decode())
        if m:
            ids = self._piece(m[1].lower())
            if m[2]:
                ids += self._piece(m[2])
        else:
            ids = self.encode(text)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = array("H", [x.id for x in self.model.tokenize(piece.translate(self.letters))]).tobytes()
            if len(piece) <= LONG_WORD:
                self.pieces[piece] = got
        return got

    def shrink(self) -> None:
        for memory in (self, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian u16.

    Where the pre-tokenizer never joins characters over white space, a text's ids
    are those of its words (cut at ASCII white space), one after the other;
    the library encodes each word once and the process remembers it.
    """
    known = _encoder(path)
    known.shrink()
    ids_of, out = known.__getitem__, []
    for t in texts:
        if t and (known.whole or known.special and known.special(t)):
            out.append(known.encode(t))
        else:
            out.append(b"".join(map(ids_of, (t or "").encode().split())))
    return out


def token_table(docs: DataFrame, tokenizer: str, doc_id="doc_id", text="text", end_id: int = 1) -> DataFrame:
    """(doc_id, ids): whole texts as u16 ids with the end id appended."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("tokens")
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = [x + end for x in encode_texts(part.column(1).to_pylist(), tokenizer)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and its offsets."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids; at most 65,536 rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column(0))[0].view("<u2"), minlength=65536)
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    out = np.zeros(65536, dtype=np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge), 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.nonzero(counts)[0]
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 2**limit:
        raise ValueError(f"{n} ids don't fit in codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    is_leaf, row = [], weights
    is_leaf.append(np.ones(n, dtype=bool))
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((weights, pairs))
        order = np.argsort(merged, kind="stable")
        row = merged[order]
        is_leaf.append(order < n)
    take = 2 * n - 2
    own = np.zeros(n, dtype=np.int64)
    for leaf in reversed(is_leaf):  # of the first `take` items, leaves lengthen their codes, packages open below
        leaves = int(leaf[:take].sum())
        own[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    if len(order):
        steps = np.left_shift(np.int64(1), MAX_LENGTH - size)  # in units of the longest code
        start = np.concatenate(([0], np.cumsum(steps)[:-1]))
        codes[order] = start >> (MAX_LENGTH - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every window of ``MAX_LENGTH`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    reach = np.left_shift(np.int64(1), MAX_LENGTH - size)
    ids, sizes = np.repeat(order, reach), np.repeat(size, reach)
    free = 2**MAX_LENGTH - len(ids)
    return np.concatenate((ids, np.zeros(free, np.int64))).astype(np.uint16), np.concatenate((sizes, np.ones(free, np.int64))).astype(np.uint8)


def encode_ids(ids: np.ndarray, starts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of documents ``ids[starts[i]:starts[i+1]]``, each byte-aligned.

    Returns the bytes, the byte offset of each document (and the end), and the
    bit offset within its document of every id.
    """
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    bits = ends[starts[1:]] - ends[starts[:-1]]
    offsets = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
    within = ends[:-1] - np.repeat(ends[starts[:-1]], np.diff(starts))
    at = within + np.repeat(offsets[:-1] * 8, np.diff(starts))
    words = np.zeros(int(offsets[-1]) // 4 + 2, dtype=np.uint32)
    word, used = at >> 5, at & 31
    both = codes[ids].astype(np.uint64) << (64 - used - size).astype(np.uint64)
    first = np.nonzero(np.concatenate(([True], word[1:] != word[:-1])))[0] if len(word) else np.empty(0, np.int64)
    if len(first):
        words[word[first]] = np.bitwise_or.reduceat((both >> np.uint64(32)).astype(np.uint32), first)
        words[word[first] + 1] |= np.bitwise_or.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.uint32), first)
    return words.astype(">u4").view(np.uint8)[: offsets[-1]], offsets, within


def decode_ids(data: np.ndarray, byte_starts: np.ndarray, counts: np.ndarray, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray], step: int = STEP) -> np.ndarray:
    """All ids of the documents; the stretches between checkpoints are decoded side by side."""
    of, sizes = table
    stretches = -(-counts // step)
    if not len(counts) or not stretches.sum():
        return np.empty(0, dtype=np.uint16)
    doc = np.repeat(np.arange(len(counts)), stretches)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    left = np.minimum(step, counts[doc] - nth * step)
    at = byte_starts[doc] * 8 + checkpoints.astype(np.int64)
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    window = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    out = np.zeros((len(doc), step), dtype=np.uint16)
    order = np.argsort(-left, kind="stable")  # stretches that end early drop off the tail
    at, active = at[order], np.searchsorted(-left[order], -np.arange(step), side="left")
    got = np.zeros((step, len(doc)), dtype=np.uint16)
    for i in range(step):
        n = int(active[i])
        if not n:
            break
        here = at[:n]
        bits = (window[here >> 3] >> (8 - (here & 7)).astype(np.uint32)) & 0xFFFF
        got[i, :n] = of[bits]
        here += sizes[bits]
    out[order] = got.T
    return out[np.arange(step)[None, :] < left[:, None]]


def write_tokens(tokens: DataFrame, path: str, ranges: int) -> np.ndarray:
    """Write (doc_id, ids) as Huffman files in ascending order of doc_id; returns the code lengths.

    Spark's range partitioning deals the rows by (doc_id, count, bits), so rows of
    one doc_id may lie in several ranges, and a range in several files.
    """
    lengths = code_lengths(id_counts(tokens))
    spark = tokens.sparkSession
    code = spark.sparkContext.broadcast((canonical_codes(lengths), lengths))  # at most 65,536 entries

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = code.value
        for batch in batches:
            for part in _pieces(batch, batch.column(1), PART_BYTES):
                raw, offsets = _flat(part.column(1))
                ids, starts = raw.view("<u2"), offsets // 2
                data, at, within = encode_ids(ids, starts, codes, sizes)
                checks = [within[a:b:STEP].astype("<u4").tobytes() for a, b in zip(starts[:-1], starts[1:])]
                bits = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts)), pa.array(checks, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "checks", "bits"])

    coded = tokens.select("doc_id", "ids").mapInArrow(compress, "doc_id long, n long, checks binary, bits binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("mark")]
    dealt = coded.withColumn("mark", F.xxhash64("bits")).withColumn("dealt", F.spark_partition_id()).repartitionByRange(ranges, *order, F.col("dealt"))
    ordered = dealt.sortWithinPartitions(*order, "dealt").select("doc_id", "n", "checks", "bits")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = code.value[1]
        for batch in batches:
            for part in _pieces(batch, batch.column(3), PART_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([_part(part, sizes)], pa.binary())], ["part"])

    (
        ordered.mapInArrow(assemble, "part binary")
        .select(F.col("part").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", PARTS)
        .option("compression", "none")
        .text(path)
    )
    return lengths


def _pieces(batch: pa.RecordBatch, column: pa.Array, at_most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose binary column has ``at_most`` bytes together, or one row."""
    sizes = np.array(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and total + size > at_most:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield batch.slice(lo)


def _part(batch: pa.RecordBatch, lengths: np.ndarray) -> bytes:
    ids = batch.column(0)
    counts = batch.column(1).to_numpy()
    checks, _ = _flat(batch.column(2))
    bits, offsets = _flat(batch.column(3))
    head = json.dumps({"docs": len(counts), "max_length": MAX_LENGTH, "step": STEP, "ids": len(lengths), "checks": len(checks) // 4, "bytes": len(bits)}).encode()
    return b"".join(
        (
            MAGIC, len(head).to_bytes(4, "little"), head, lengths.tobytes(),
            np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(),
            counts.astype("<u4").tobytes(), np.diff(offsets).astype("<u4").tobytes(), checks.tobytes(), bits.tobytes(),
        )
    )


def read_parts(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, null flags, ids per document, all ids) of each part of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError("not a part of a token file")
        size = int.from_bytes(content[at + 4 : at + 8], "little")
        head = json.loads(content[at + 8 : at + 8 + size])
        at += 8 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        lengths, n = take("u1", head["ids"]), head["docs"]
        ids, null, counts, nbytes, checks, data = take("<i8", n), take("u1", n), take("<u4", n), take("<u4", n), take("<u4", head["checks"]), take("u1", head["bytes"])
        starts = np.concatenate(([0], np.cumsum(nbytes.astype(np.int64))[:-1])).astype(np.int64)
        yield ids, null, counts.astype(np.int64), decode_ids(data, starts, counts.astype(np.int64), checks, decode_table(lengths), head["step"])
        at += 1  # the line feed


def read_tokens(df_files: DataFrame) -> DataFrame:
    """One row per document from (path, content) of token files: place, count, CRC-32 of its ids as u32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                base = 0
                for ids, null, counts, tokens in read_parts(content.as_py()):
                    ends = np.cumsum(counts)
                    wide = tokens.astype("<u4")
                    crc = [zlib.crc32(wide[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, pa.string()), pa.array(ids, mask=null.astype(bool)), pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                        ["path", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )
                    base += int(ends[-1]) if n else 0

    return df_files.mapInArrow(decode, "path string, doc_id long, local long, n_tokens long, ids_crc32 long")


def through_files(docs: DataFrame, tokenizer: str | None = None, doc_id="doc_id", text="text", end_id: int = 1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of every document.

    ``start`` adds up per file first: one row per file is ranked, never the documents.
    """
    spark = docs.sparkSession
    tokens = stored(token_table(docs, tokenizer or default_tokenizer(), doc_id, text, end_id), "tokens")
    size = tokens.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0]
    path = new_path(spark, "huffman")
    write_tokens(tokens, path, max(1, -(-size // range_bytes)))
    forget(tokens)
    found = stored(read_tokens(spark.read.format("binaryFile").load(path).select("path", "content")), "decoded")
    sizes = found.groupBy("path").agg(F.sum("n_tokens").alias("in_file"))
    place = [F.regexp_extract("path", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)")]
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("path", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("before"))
    out = found.join(first.hint("merge"), "path")
    return out.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
