"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans come from fixed patterns for e-mail addresses, IP addresses, card
and phone numbers. They are the seeds, with one weak kind more: strings of 32
or more hexadecimal digits, letters and figures both, seed the kind ``secret`` but
are no spans of their own; only a pattern makes one a span. Every token that looks like an
identifier (it holds a digit or @), and every maximal run of groups of digits
joined by single blanks, hyphens, dots or parentheses (with the letters that
stand at its ends, as in DE89 3704), is a mention if it has ``LEAST`` or more
letters or digits. It stands in up to three lexical patterns, from exact to
general: two words before and one after; two words before; one before and one
after (a pattern with nothing but empty words is none). Words are folded, marks
without a letter or digit stay, and what is glued to the mention's front is the
word before it. Spark scores the graph of patterns and instances in rounds: an
instance known as a seed of kind k lends its patterns weight, a pattern's score
for k is the share of its distinct instances that are known as k (from
``SUPPORT`` instances on), and instances seen in high-scoring patterns become
known, until a round makes no instance known. Mentions that stand in a pattern
of ``CONFIDENCE`` or more and overlap no base span are added, unless they lie in
a longer one that is; base spans always stay.

Defined cases: a null text is empty; equal rows are reported alike; mentions
at the edge of a text have empty context words; ties between kinds go to the
first in KINDS, then secret; a null doc_id is reported as null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, salted_lookup, stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the graph: what base patterns find, and what only contexts find.
EVERY = (*KINDS, "secret")
LEAST, SUPPORT, CONFIDENCE = 7, 5, 0.9

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always begins where a run of digits does, so no start inside a run is tried.
_ip = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Possessive throughout: a run of groups is read once. Between groups stands one separator, or a parenthesis with one.
_run = re.compile(r"\(?[0-9]++(?:(?:[\x20.-]\(?|\)[\x20.-]?\(?|\()[0-9]++)*+")
_hex = re.compile(r"[0-9a-f]{32,}+|[0-9A-F]{32,}+")
_hint = re.compile(r"[0-9@]")
_spaces = re.compile(r"\s")
_digits = re.compile(r"[0-9]")
_folded = re.compile(r"[^\W_]+")
_word = re.compile(r"\S+")


def _emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
        else:
            low = max(low, at + 1)  # no later match can hold this @
        at = text.find("@", low)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points, end exclusive."""
    if not _hint.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(map(_small, m.groups()))]
    for m in _card.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _phone.finditer(text):
        if 9 <= len(_digits.findall(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[str], str]]:
    """(seed kind or '', start, end, patterns, instance) of the base spans, and of identifier-like tokens and runs of digits outside them."""
    if not base and not _hint.search(text):
        return []
    taken = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    unseen, i = set(), 0
    for a, b in _hinted(text):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        core = text[a:b]
        lead, tail = len(core) - len(core.lstrip("\"'([{<,;:.!?*#$%&")), len(core) - len(core.rstrip("\"')]}>,;:.!?*#$%&"))
        unseen.add((a + lead, b - tail))
    for low, high in zip([0, *(b for _, b in taken)], [*(a for a, _ in taken), len(text)]):
        unseen.update(_runs(text, low, high))
    found = [(k, a, b) for k, a, b in base]
    found += [(_seed_kind(text[a:b]), a, b) for a, b in sorted(unseen) if b > a and sum(map(str.isalnum, text[a:b])) >= LEAST]
    out, context = [], _Context(text)
    for kind, a, b in sorted(found, key=lambda f: f[1]):
        out.append((kind, a, b, context.patterns(a, b), hashlib.blake2b(text[a:b].encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()))
    return out


def _seed_kind(token: str) -> str:
    m = _hex.fullmatch(token)
    return "secret" if m and not token.isdigit() and any(map(str.isdigit, token)) else ""


class _Context:
    """Whole words around the mentions of a text, asked for from left to right."""

    def __init__(self, text: str):
        self.text, self.end, self.at, self.left = text, 0, -1, ["", ""]

    def _before(self, at: int) -> tuple[str, int]:
        """The folded word that ends before a place, and where it begins."""
        text = self.text
        while at and text[at - 1].isspace():
            at -= 1
        end = at
        while at and not text[at - 1].isspace():
            at -= 1
        return _fold(text[at:end]), at

    def patterns(self, a: int, b: int) -> list[str]:
        start = a
        while start > self.end and not self.text[start - 1].isspace():
            start -= 1  # never back over an earlier mention, so a text is read once
        glued = _fold(self.text[start:a])
        if start != self.at:
            one, at = self._before(start)
            self.left, self.at = [self._before(at)[0], one], start
        m = _word.search(self.text, b)
        right = _fold(m.group()) if m else ""
        two, one = [*self.left, glued][-2:] if glued else self.left
        self.end = max(self.end, b)
        shapes = [("a", two, one, right), ("b", two, one), ("c", one, right)]
        return [hashlib.blake2b("\x1f".join(s).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() for s in shapes if any(s[1:])]


def _runs(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of groups of digits between two places, with the letters that touch them; no piece of a token of letters and digits."""
    for m in _run.finditer(text, low, high):
        a, b = m.span()
        if text[a] == "(" and ")" not in m.group():
            a += 1
        while a > low and text[a] != "(" and text[a - 1].isalpha():
            a -= 1
        while b < high and text[b].isalpha():
            b += 1
        if b < high and text[b] == ")" and text.count("(", a, b) > text.count(")", a, b):
            b += 1
        whole = not (a > low and text[a - 1].isalnum() or b < high and text[b].isalnum())
        if whole or " " in m.group():
            yield a, b


def _hinted(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between white space that hold a digit or @."""
    at = 0
    while m := _hint.search(text, at):
        end = _spaces.search(text, m.end())
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = end.start() if end else len(text)
        yield start, at


def _fold(word: str) -> str:
    """Letters in lower case, every figure 0; a word without either as it is, but for quotes."""
    return "".join(_folded.findall(_digits.sub("0", word.lower()))) or word.strip("\"'`")


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (EVERY.index(s[0]), s[1], s[2])))


def described(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: base counts and spans, and all its mentions."""
    names = [*(f"n_{k}" for k in KINDS), "base"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, bases, found = [[] for _ in KINDS], [], []
                for t in part.column(1).to_pylist():
                    base = base_spans(t or "")
                    for c, k in zip(counts, KINDS):
                        c.append(sum(s[0] == k for s in base))
                    bases.append(listed(base))
                    found.append([dict(zip(("kind", "start", "end", "patterns", "instance"), m)) for m in mentions(t or "", base)])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(bases, pa.string()), pa.array(found, kind)], ["doc_id", *names, "mentions"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, mentions array<struct<kind:string,start:int,end:int,patterns:array<string>,instance:string>>"
    return rows.mapInArrow(describe, schema)


def good_patterns(edges: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, good_rank: the patterns of high confidence, from distinct (pattern, instance) edges with seed ranks.

    An instance counts once for a pattern however often it occurs, so copied
    passages don't lend weight. Hot patterns are pre-aggregated; known
    instances reach their edges by salted joins. Without ``rounds`` (1 or more)
    it goes on until nothing changes: known instances only become more and their
    ranks only fall, so it ends.
    """
    known = stored(edges.where(F.col("rank") < len(EVERY)).groupBy("instance").agg(F.min("rank").alias("rank")), "pii-seeds")
    pairs, state = edges.select("pattern", "instance"), None
    for turn in itertools.count(1):
        seen = salted_lookup(pairs, known, "instance", F.col("pattern"))
        tally = seen.groupBy("pattern").agg(F.count("*").alias("all"), *[F.count_if(F.col("rank") == i).alias(f"k{i}") for i in range(len(EVERY))])
        best = F.greatest(*[F.struct(F.col(f"k{i}").alias("hits"), F.lit(-i).alias("r")) for i in range(len(EVERY))])
        good = tally.withColumn("best", best).where((F.col("best.hits") >= support) & (F.col("best.hits") >= confidence * F.col("all")))
        good = stored(good.select("pattern", (-F.col("best.r")).alias("good_rank"), (F.col("best.hits") / F.col("all")).alias("score")), "pii-patterns")
        if turn == rounds or good.isEmpty():
            break
        state = state or known.agg(F.count("*"), F.sum("rank")).first()
        found = salted_lookup(pairs, good, "pattern", F.col("instance"), how="inner").groupBy("instance").agg(F.min("good_rank").alias("rank"))
        last, known = known, stored(known.unionByName(found).groupBy("instance").agg(F.min("rank").alias("rank")), "pii-known")
        forget(last)
        before, state = state, known.agg(F.count("*"), F.sum("rank")).first()
        if state == before:
            break
    return good.select("pattern", "good_rank")


def edges_of(each: DataFrame) -> DataFrame:
    """Distinct (pattern, instance) of mentions (patterns, instance, rank) with the least seed rank."""
    return each.select(F.explode("patterns").alias("pattern"), "instance", "rank").groupBy("pattern", "instance").agg(F.min("rank").alias("rank"))


def personal_data(docs: DataFrame, doc_id="doc_id", text="text", rounds: int | None = None) -> DataFrame:
    """doc_id, base counts, ``base`` and ``spans`` lists, and ``n_added`` of every row."""
    rows = stored(described(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(EVERY)], F.lit(len(EVERY)))
    each = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*").withColumn("rank", rank)
    good = good_patterns(stored(edges_of(each), "pii-edges"), rounds)
    unseen = each.where(~F.col("kind").isin(*KINDS)).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    added = salted_lookup(unseen, good, "pattern", F.col("row"), how="inner").groupBy("row", "start", "end").agg(F.min("good_rank").alias("good_rank"))
    kinds = F.array(*[F.lit(k) for k in EVERY])
    longer = F.max("end").over(Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    added = added.withColumn("longer", longer).where(F.col("longer").isNull() | (F.col("end") > F.col("longer")))
    added = added.groupBy("row").agg(F.collect_list(F.struct(F.col("good_rank").alias("r"), F.element_at(kinds, F.col("good_rank") + 1).alias("k"), F.col("start").alias("a"), F.col("end").alias("b"))).alias("added"))
    base = F.filter(F.transform(F.split("base", ","), lambda s: F.split(s, ":")), lambda s: F.size(s) == 3)
    base = F.transform(base, lambda s: F.struct((F.array_position(kinds, s[0]).cast("int") - 1).alias("r"), s[0].alias("k"), s[1].cast("int").alias("a"), s[2].cast("int").alias("b")))
    every = F.array_sort(F.concat(base, F.col("added")))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")
    out = rows.drop("mentions").join(added.hint("merge"), "row", "left")
    out = out.withColumn("n_added", F.coalesce(F.size("added"), F.lit(0)).cast("long"))
    return out.withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(spans)).drop("row", "added")
