"""Symbol libraries in S-expressions: bounded reader and one row per symbol.

A library over 2 MiB, 250,000 tokens or 128 levels gives one row with an error
code instead of symbols. ``symbols`` reads the few fields of a listing, ``records`` all
that a symbol says of itself; what it inherits is joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES, MAX_TOKENS, MAX_DEPTH = 2 * 1024 * 1024, 250_000, 128
_TOKEN = re.compile(r'\s*(?:([()])|"((?:[^"\\]|\\.)*)"|([^\s()"]+))')
SCHEMA = "path string, symbol string, description string, n_pins int, error string"


def tree(text: str) -> list:
    """Nested lists of atoms; ValueError names the limit or fault."""
    stack: list[list] = [[]]
    at, count, end = 0, 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("bad_token")
        at, count = m.end(), count + 1
        if count > MAX_TOKENS:
            raise ValueError("too_many_tokens")
        if m[1] == "(":
            stack.append([])
            if len(stack) > MAX_DEPTH:
                raise ValueError("too_deep")
        elif m[1] == ")":
            if len(stack) < 2:
                raise ValueError("unbalanced")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3])
    if len(stack) != 1:
        raise ValueError("unbalanced")
    return stack[0]


def _rows(path: str, content: bytes) -> list[tuple]:
    try:
        if len(content) > MAX_BYTES:
            raise ValueError("too_large")
        out = []
        for library in tree(content.decode()):
            for node in library:
                if isinstance(node, list) and node[:1] == ["symbol"]:
                    fields = {x[1]: x[2] for x in node if isinstance(x, list) and x[:1] == ["property"] and len(x) > 2}
                    out.append((path, node[1], fields.get("Description"), sum(isinstance(x, list) and x[:1] == ["pin"] for x in node), None))
        return out
    except (ValueError, UnicodeDecodeError) as e:
        return [(path, None, None, 0, str(e) if not isinstance(e, UnicodeDecodeError) else "not_utf8")]


def symbols(files: DataFrame) -> DataFrame:
    """(path, content) of libraries to one row per symbol."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _rows(p, c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "symbol", "description", "n_pins", "error"])

    return files.select("path", "content").mapInArrow(read, SCHEMA)


RECORDS = (
    "path string, nth int, root string, version string, symbol string, props map<string,string>, extends string, filters array<string>,"
    " pins array<struct<number:string,name:string,electrical:string,unit:int>>, error string"
)
_UNIT = re.compile(r"_([1-9][0-9]*)_[0-9]+$")


def _atom(node: list, i: int) -> str | None:
    return node[i] if len(node) > i and isinstance(node[i], str) else None


def _named(node: list, name: str) -> list[list]:
    """The lists directly in ``node`` that begin with ``name``."""
    return [x for x in node if isinstance(x, list) and x[:1] == [name]]


def _value(node: list, name: str) -> str | None:
    return next((v for x in _named(node, name) if (v := _atom(x, 1)) is not None), None)


def _pin(pin: list, unit: int) -> dict:
    return {"number": _value(pin, "number"), "name": _value(pin, "name"), "electrical": _atom(pin, 1) or "unspecified", "unit": unit}


def _symbol(node: list) -> dict:
    """The own fields of one symbol; pins of nested symbols belong to the unit in their name's suffix."""
    name = _atom(node, 1)
    pins = [_pin(p, 1) for p in _named(node, "pin")]
    for nested in _named(node, "symbol"):
        suffix = _UNIT.search(_atom(nested, 1) or name or "")
        pins += [_pin(p, int(suffix[1]) if suffix else 1) for p in _named(nested, "pin")]
    props = {k: v for x in _named(node, "property") if (k := _atom(x, 1)) is not None and (v := _atom(x, 2)) is not None}
    filters = [x for group in _named(node, "footprint_filters") for x in group[1:] if isinstance(x, str) and x.strip()]
    return {"symbol": name, "props": list(props.items()), "extends": _value(node, "extends"), "filters": list(dict.fromkeys(filters)), "pins": pins}


def _records(path: str, content: bytes) -> Iterator[dict]:
    try:
        if len(content) > MAX_BYTES:
            raise ValueError("too_large")
        libraries = [x for x in tree(content.decode()) if isinstance(x, list)]
    except (ValueError, UnicodeDecodeError) as e:
        yield {"path": path, "error": "not_utf8" if isinstance(e, UnicodeDecodeError) else str(e)}
        return
    for library in libraries[:1]:
        for nth, node in enumerate(_named(library, "symbol")):
            yield {"path": path, "nth": nth, "root": _atom(library, 0), "version": _value(library, "version"), **_symbol(node)}


def records(files: DataFrame) -> DataFrame:
    """(path, content) of libraries to one row per symbol, in order, with all its own fields; a faulty library is one row with its error."""
    schema = pa.schema([
        ("path", pa.string()), ("nth", pa.int32()), ("root", pa.string()), ("version", pa.string()), ("symbol", pa.string()), ("props", pa.map_(pa.string(), pa.string())), ("extends", pa.string()),
        ("filters", pa.list_(pa.string())), ("pins", pa.list_(pa.struct([("number", pa.string()), ("name", pa.string()), ("electrical", pa.string()), ("unit", pa.int32())]))), ("error", pa.string()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist(list(_records(p, c or b"")), schema)

    return files.select("path", "content").mapInArrow(read, RECORDS)
