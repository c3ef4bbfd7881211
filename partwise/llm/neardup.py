"""Near-duplicate groups by SetSketch registers, checked on full shingle sets.

A document's set holds its distinct ``SHINGLE``-word shingles (64-bit hashes).
Documents with equal sets form one node. A node's SetSketch has ``REGISTERS``
registers ``clip(floor(1 - log_b(m_j)))`` of the truncated, exponentially
spaced minima ``m_j``; sketches merge by the larger register. Bands of four
registers put nodes into buckets: at a Jaccard similarity of 0.75 two nodes miss
all 40 bands with probability below 3e-7.

1. Near pairs: members of a bucket are compared, in blocks, by the
   maximum-likelihood estimate of the Jaccard similarity from register order
   and set sizes. A large bucket meets its first member alone before that; those
   near it are one component and aren't held against each other. Pairs that may reach the threshold (estimate down to
   ``MARGIN`` below it, about five standard deviations) are near; a spanning
   forest of them joins nodes to clusters, which hold every pair that may link.
2. Links: the full shingle sets of a cluster meet in the same way (a large one
   its first member alone, then those without a link to it all others), and an
   inverted index over a block gives all intersections. A spanning forest of the exact
   links makes the components.

So a link is lost only by the stated sketch probabilities, and no bucket is
cut. Hot buckets and clusters meet block by block, copy groups are
pre-aggregated and salted. Every link is checked on full sets.

Defined cases: null or wordless texts have an empty set (size 0), link with
nothing and are kept; a very long text is read whole by one worker, at about 22
bytes of memory a byte (measured on 10 MB); rows with a null doc_id link with nothing (component
null, kept); equal doc_ids in several rows are separate texts with one id, and
``deduplicated`` keeps or drops each of them by its own text; ties between
members of a group go to the smaller doc_id, then node; other columns are handed
through by position, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import forget, remember_in, row_of, rows_again, salted_lookup, stored, use_memory

SHINGLE = 5
BAND, BANDS = 4, 40
REGISTERS = BAND * BANDS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
PERCENT = 75
MARGIN = 0.17
#: Members of a bucket or cluster that one task compares with as many others.
BLOCK = 256
#: Ids up to which the texts of clusters are picked by a broadcast of their ids (8 bytes each).
PICK_ROWS = 500_000

_mix = np.random.default_rng(20240117)
FACTORS = (_mix.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
SHIFTS = _mix.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]


class _Remembered(dict):
    """Word hashes of this process, made as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Remembered()
remember_in("neardup", _hashes)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > 500_000:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; all its words at once if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    width = min(SHINGLE, len(h))
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return np.unique(_scramble(total))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        values = np.multiply(FACTORS, x[None, at : at + 2048])
        values += SHIFTS
        np.minimum(least, values.min(axis=1), out=least)
    minimum = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def jaccard_estimate(greater: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers are greater or less, given the set sizes."""
    total = size_a + size_b
    u, v = size_a / total, size_b / total
    equal = REGISTERS - greater - less
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, None) * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, fewer = p(u - v * j), p(v - u * j)
        return greater * np.log(more) + less * np.log(fewer) + equal * np.log(np.maximum(1 - more - fewer, 1e-12))

    for _ in range(30):  # the likelihood is concave in j
        a, b = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(a) < likelihood(b)
        low, high = np.where(better, a, low), np.where(better, high, b)
    return (low + high) / 2


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int64))


def described(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, size of the set, node (hash of the set, null if empty), registers."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("neardup")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, nodes, sketches = [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t)
                    sizes.append(len(s))
                    nodes.append(node_of(s) if len(s) else None)
                    sketches.append(set_sketch(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "n", "node", "registers"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(describe, "doc_id long, n long, node long, registers binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node, n): one row per node and band."""
    seed = _scramble(np.arange(1, BANDS + 1, dtype=np.uint64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                registers = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint64).reshape(-1, BANDS)
                keys = _scramble(registers * np.uint64(0x9E3779B97F4A7C15) + seed[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), _long(np.repeat(part.column(0).to_numpy(), BANDS)), _long(np.repeat(part.column(1).to_numpy(), BANDS))], ["key", "node", "n"])

    return nodes.select("node", "n", "registers").mapInArrow(cut, "key long, node long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b).

    Each round hooks every root to its smallest neighbour, jumps pointers until
    they end in roots, and relabels the edges; the edges that are left shrink
    at least by half.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, left = None, edges
    while True:
        left = stored(both(left.where("a != b")).distinct(), "cc-edges")
        if left.isEmpty():
            return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
        parents = left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        parents = stored(parents, "cc-parents")
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = salted_lookup(parents, up, "root", F.col("node"), 32).select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved"))
            last, jumped = parents, stored(jumped, "cc-jump")
            forget(last)
            moved = not jumped.where("moved").isEmpty()
            parents = jumped.select("node", "root")
            parents.stored_at = jumped.stored_at
            if not moved:
                break
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = stored(salted_lookup(labels, up, "root", F.col("node"), 32).select("node", F.coalesce("next", "root").alias("root")), "cc-labels")
        a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = salted_lookup(salted_lookup(left, a, "a", F.col("b"), 32), b, "b", F.col("a"), 32).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _near_pairs(col: dict[str, np.ndarray], ends: np.ndarray, at_once: int = 400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (x, y) of one group, of different components, whose estimate comes near the threshold; and the estimate.

    ``ends``: for each row, where its group ends. All groups of a batch are
    paired side by side, ``at_once`` pairs at a time.
    """
    n, comp, own, apart, regs = (col[k] for k in ("n", "comp", "own", "apart", "regs"))
    counts = ends - np.arange(len(ends)) - 1
    upto = np.concatenate(([0], np.cumsum(counts)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, side="right")) - 1)
        x = np.repeat(np.arange(lo, hi), counts[lo:hi])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[lo:hi] - upto[lo], counts[lo:hi])
        fit = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & (~apart[x] | (own[x] != own[y]))
        x, y = x[fit], y[fit]
        for at in range(0, len(x), 16384):
            a, b = x[at : at + 16384], y[at : at + 16384]
            ra, rb = regs[a], regs[b]
            greater, less = (ra > rb).sum(1), (ra < rb).sum(1)
            near = REGISTERS - greater - less >= 0.45 * REGISTERS
            a, b = a[near], b[near]
            if len(a):
                guess = jaccard_estimate(greater[near], less[near], n[a].astype(float), n[b].astype(float))
                good = guess >= PERCENT / 100 - MARGIN
                found.append((a[good], b[good], guess[good]))
        lo = hi
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(f) for f in zip(*found))


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (x, y) of rows below ``n`` form a spanning forest."""
    label, keep = np.arange(n), np.zeros(len(x), dtype=bool)
    starts = np.concatenate(([0], np.nonzero(np.diff(x))[0] + 1, [len(x)])) if len(x) else np.zeros(1, np.int64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):  # all pairs of one row x, which are together
        own = label[x[a]]
        found, first = np.unique(label[y[a:b]], return_index=True)
        other = found != own
        if other.any():
            keep[a + first[other]] = True
            label[np.isin(label, found[other])] = own
    return keep


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows of groups once for each pair of blocks (i, j) of their group that they take part in.

    ``size`` members, ``left`` of them not ``joined`` to the group's first one.
    The joined are one component already and are only held against the others.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = rows.where("left > 0").withColumn("open", blocks(F.col("left"))).withColumn("shut", blocks(F.col("size") - F.col("left")))
    own = F.when(F.col("joined"), F.col("open") + F.pmod(F.xxhash64("node"), F.greatest("shut", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("open"))).cast("int")
    last = F.when(F.col("joined"), F.col("open")).otherwise(F.col("open") + F.col("shut")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.drop("size", "left", "joined", "open", "shut", "other").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _met(rows: DataFrame, key: str, fields: list[str], test, name: str) -> tuple[DataFrame, DataFrame]:
    """Block pairs of groups (key, size, node, *fields), and edges (a, b) that are found on the way.

    A group of more than ``BLOCK`` members is first held against its first
    member alone, which is linear; ``test`` says which rows are linked with it.
    """
    rows = stored(rows.select(key, "size", "node", *fields), name)
    small = rows.where(F.col("size") <= BLOCK).withColumn("left", F.col("size")).withColumn("joined", F.lit(False))
    large = rows.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return _in_blocks(small, key), None
    first = large.groupBy(key).agg(F.min(F.struct("node", *fields)).alias("first"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                linked = test(part) if part.num_rows else np.empty(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, "size", "node", *fields)), part.column("first").field("node"), pa.array(linked, pa.bool_())], [key, "size", "node", *fields, "head", "joined"])

    spread = salted_lookup(large, first, key, F.col("node"), how="inner").select(key, "size", "node", *fields, "first")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    held = stored(spread.mapInArrow(hold, f"{kinds}, head long, joined boolean"), f"{name}-held")
    left = held.where("not joined").groupBy(key).agg(F.count("*").alias("left"))
    rest = salted_lookup(held.drop("head"), left, key, F.col("node"), how="inner").select(*small.columns)
    edges = held.where("joined and node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    return _in_blocks(small.unionByName(rest), key), edges


def _by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups (key, i, j) of sorted rows as tables, and where each group begins (and the last ends)."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in (key, "i", "j")])
        starts = np.concatenate(([0], np.nonzero((np.diff(keys, axis=1) != 0).any(axis=0))[0] + 1)) if table.num_rows else np.zeros(1, np.int64)
        if len(starts) > 1:  # the last group may go on in the next batch
            yield table.slice(0, int(starts[-1])), starts
        rest = table.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _edges(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_long(np.minimum(node[x], node[y])), _long(np.maximum(node[x], node[y]))], ["a", "b"])


def _near_first(part: pa.RecordBatch) -> np.ndarray:
    """Which rows may reach the threshold with the first of their group, by the estimate."""
    first = part.column("first")
    regs = lambda x: np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    a, b = regs(part.column("registers")), regs(first.field("registers"))
    n, m = part.column("n").to_numpy().astype(float), first.field("n").to_numpy().astype(float)
    guess = jaccard_estimate((a > b).sum(1), (a < b).sum(1), n, m)
    return (part.column("node").to_numpy() == first.field("node").to_numpy()) | ((guess >= PERCENT / 100 - MARGIN) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)))


def _linked_first(part: pa.RecordBatch) -> np.ndarray:
    """Which rows' full sets reach the threshold with the first of their cluster."""
    out = np.zeros(part.num_rows, dtype=bool)
    for i, (own, first) in enumerate(zip(part.column("shingles"), part.column("first").field("shingles"))):
        a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (own, first))
        both = len(np.intersect1d(a, b, assume_unique=True))
        out[i] = 100 * both >= PERCENT * (len(a) + len(b) - both)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the near pairs of each run of buckets."""
    for table, starts in _by_group(batches, "key"):
        col = {c: table.column(c).to_numpy() for c in ("own", "node", "n", "i", "j")}
        col["apart"] = col["i"] != col["j"]
        col["regs"] = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        names, col["comp"] = np.unique(col["node"], return_inverse=True)
        x, y, _ = _near_pairs(col, np.repeat(starts[1:], np.diff(starts)))
        a, b = np.minimum(col["comp"][x], col["comp"][y]), np.maximum(col["comp"][x], col["comp"][y])
        pairs = np.unique(np.stack((a, b)), axis=1) if len(a) else np.empty((2, 0), np.int64)
        keep = _forest(pairs[0], pairs[1], len(names))
        yield _edges(names, pairs[0][keep], pairs[1][keep])


def exact_links(sets: list[np.ndarray], own: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the rows whose sets reach the threshold; ``apart``: only rows of different blocks meet."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    posts = row[order]
    ends = np.concatenate(([0], np.cumsum(np.bincount(shingle))))
    begin = np.concatenate(([0], np.cumsum(n)))
    label, out_x, out_y = np.arange(len(sets)), [], []
    for x in range(len(sets) - 1):
        mine = shingle[begin[x] : begin[x + 1]]
        count = ends[mine + 1] - ends[mine]
        at = np.repeat(ends[mine] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        both = np.bincount(posts[at], minlength=len(sets))[x + 1 :]
        linked = (100 * both >= PERCENT * (n[x] + n[x + 1 :] - both)) & (label[x + 1 :] != label[x])
        if apart:
            linked &= own[x + 1 :] != own[x]
        found, first = np.unique(label[x + 1 :][linked], return_index=True)
        if len(found):
            out_x += [x] * len(found)
            out_y += (np.nonzero(linked)[0][first] + x + 1).tolist()
            label[np.isin(label, found)] = label[x]
    return np.array(out_x, dtype=np.int64), np.array(out_y, dtype=np.int64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the exact links of each block of a cluster."""
    for table, starts in _by_group(batches, "root"):
        node, own, i, j = (table.column(c).to_numpy() for c in ("node", "own", "i", "j"))
        blocks = table.column("shingles").to_pylist()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a > 1:
                x, y = exact_links([np.frombuffer(s, dtype=np.uint64) for s in blocks[a:b]], own[a:b], bool(i[a] != j[a]))
                yield _edges(node[a:b], x, y)


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, root, size, shingles) for nodes (node, doc_id, root, size); their number decides how their ids reach the texts."""
    few = wanted.limit(PICK_ROWS + 1).count() <= PICK_ROWS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("neardup")
        seen: set[int] = set()  # equal rows give their set once
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets, same = [], []
                for node, t in zip(part.column(0).to_pylist(), part.column(3).to_pylist()):
                    sets.append(np.empty(0, np.uint64) if node in seen else shingle_set(t))
                    same.append(len(sets[-1]) > 0 and node_of(sets[-1]) == node)  # an id may have other texts
                    if same[-1]:
                        seen.add(node)
                same = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "size", "shingles"]).filter(same)

    rows = docs.join(F.broadcast(wanted) if few else wanted.hint("merge"), "doc_id").select("node", "root", "size", "text")
    return rows.mapInArrow(build, "node long, root long, size long, shingles binary")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n, node and lead (the smallest doc_id of the group and its node) of every row of (doc_id, text)."""
    table = stored(described(docs), "sketches")
    linked = table.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = stored(
        linked.groupBy("node").agg(F.min(F.struct("doc_id", "n", "registers")).alias("s"), F.count("*").alias("copies")).select("node", "copies", "s.*"),
        "nodes",
    )
    members = _bands(nodes)
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = salted_lookup(members.drop("n"), buckets, "key", F.col("node"), 8, how="inner")
    blocks, edges = _met(shared.join(nodes.select("node", "n", "registers").hint("merge"), "node"), "key", ["n", "registers"], _near_first, "buckets")
    near = blocks.select("key", "i", "j", "own", "node", "n", "registers").mapInArrow(_compare, "a long, b long")
    near = (near if edges is None else near.unionByName(edges)).distinct()
    clusters = components(near)
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    wanted = salted_lookup(clusters.join(nodes.select("node", "doc_id").hint("merge"), "node"), sizes, "root", F.col("node"))
    blocks, edges = _met(_shingle_sets(docs, stored(wanted, "clusters")), "root", ["shingles"], _linked_first, "sets")
    links = blocks.select("root", "i", "j", "own", "node", "shingles").mapInArrow(_link, "a long, b long")
    labels = components(links if edges is None else links.unionByName(edges))

    rooted = nodes.join(labels.hint("merge"), "node", "left").select("node", "doc_id", "copies", "root")
    least = rooted.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("lead"))
    of_found = salted_lookup(rooted.where("root is not null"), least, "root", F.col("node")).select("node", "lead")
    of_copies = rooted.where("root is null and copies > 1").select("node", F.struct("doc_id", "node").alias("lead"))
    answer = salted_lookup(table.select("doc_id", "n", "node"), of_found.unionByName(of_copies), "node", F.col("doc_id"))
    alone = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node"))
    return answer.select("doc_id", "n", "node", F.when(F.col("doc_id").isNotNull(), F.coalesce("lead", alone)).alias("lead"))


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    found = _grouped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    kept = F.coalesce(F.col("doc_id") == F.col("lead.doc_id"), F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, all without a doc_id or a word; columns as given.

    The texts of a group go, not their ids: a row leaves if its (doc_id, node)
    is not its group's lead. Only rows with an id that such a text or a
    repeated row has are looked at again.
    """
    found = stored(_grouped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))), "groups")
    texts = found.where("doc_id is not null and node is not null").groupBy("doc_id", "node", "lead").agg(F.count("*").alias("times"))
    stays = (F.col("doc_id") == F.col("lead.doc_id")) & (F.col("node") == F.col("lead.node"))
    again = stored(texts.select("doc_id", "node", "times", stays.alias("stays")).where("not stays or times > 1"), "again")
    ids = again.select(F.col("doc_id").alias("again")).distinct()
    few = ids.limit(PICK_ROWS + 1).count() <= PICK_ROWS
    ids = F.broadcast(ids) if few else ids.hint("merge")
    packed = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), row_of(docs).alias("row"))
    clear = packed.join(ids, F.col("id") == F.col("again"), "left_anti")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("neardup")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = map(shingle_set, part.column(1).to_pylist())
                nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), nodes], ["id", "row", "node"])

    doubtful = packed.join(ids, F.col("id") == F.col("again"), "left_semi")
    schema = StructType([packed.schema["id"], packed.schema["row"], StructField("node", LongType())])
    named = doubtful.mapInArrow(name, schema)
    known = again.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "stays")
    judged = named.join(F.broadcast(known) if few and known.limit(PICK_ROWS + 1).count() <= PICK_ROWS else known.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("node") == F.col("_node")), "left")
    once = judged.where("stays").groupBy("id", "node").agg(F.first("row").alias("row")).select("row")  # equal sets under one id, combined before the shuffle
    return rows_again(clear.select("row").unionByName(judged.where("stays is null").select("row")).unionByName(once), docs)
