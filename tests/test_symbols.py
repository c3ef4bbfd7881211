"""Inheritance against a walk of every chain; records of odd libraries."""

import random

from partwise.operators.inheritance import inherited
from partwise.sources import sexpr


def walk(rows):
    known = {(lib, name): (up, a, b) for lib, name, up, a, b in rows}
    out = {}
    for lib, name, up, a, b in rows:
        seen, at, depth, own = [name], name, 0, (a, b)
        status = "none"
        while True:
            nxt = known[lib, at][0]
            if nxt is None:
                break
            if (lib, nxt) not in known:
                status = "missing_parent"
                break
            if nxt in seen:
                status = "cycle"
                break
            seen.append(nxt)
            at, depth, status = nxt, depth + 1, "ok"
            a, b = (x if x is not None else y for x, y in zip((a, b), known[lib, at][1:]))
        out[lib, name] = (*own, None, None, "cycle") if status == "cycle" else (a, b, depth, at, status)
    return out


def test_chains_cycles_and_missing_parents(spark):
    rng, rows = random.Random(8), []
    for lib in ("x", "y", None):
        for k in range(60):
            up = rng.choice([None, f"n{rng.randint(0, 59)}", f"n{max(0, k - 1)}", "gone"])
            rows.append((lib or "z", f"n{k}", up, rng.choice([None, f"a{k}"]), rng.choice([None, k])))
    rows += [("long", f"m{k}", f"m{k - 1}" if k else None, "top" if not k else None, None) for k in range(40)]
    df = spark.createDataFrame(rows, "lib string, name string, up string, a string, b int")
    got = {(r.lib, r.name): (r.a, r.b, r.depth, r.ancestor, r.inherits) for r in inherited(df, ["lib", "name"], "up", ["a", "b"]).collect()}
    assert got == walk(rows)
    assert got["long", "m39"] == ("top", None, 39, "m0", "ok") and {v[-1] for v in got.values()} == {"none", "ok", "cycle", "missing_parent"}
    assert inherited(df.limit(0), ["lib", "name"], "up", ["a", "b"]).count() == 0


def test_records_of_odd_libraries(spark):
    files = [
        ("a/ok.sym", b'(lib (version 1) (symbol "S" (property "Value" "v") (property "Value" "w") (property "Lone") (extends "T") (pin input line (number "1")) (symbol "S_2_1" (pin (name "n") (number "2"))) (symbol "S_x" (pin output))) (symbol) (other))'),
        ("a/bad.sym", b"(lib (symbol"), ("a/bytes.sym", b"\xff\xfe"), ("a/empty.sym", b""), ("a/null.sym", None), ("a/deep.sym", b"(" * 200),
    ]
    rows = {}
    for r in sexpr.records(spark.createDataFrame(files, "path string, content binary")).collect():
        rows.setdefault(r.path, []).append(r)
    first, second = sorted(rows["a/ok.sym"], key=lambda r: r.nth)
    assert (first.root, first.version, first.symbol, first.props, first.extends, first.filters) == ("lib", "1", "S", {"Value": "w"}, "T", [])
    assert [tuple(p) for p in first.pins] == [("1", None, "input", 1), ("2", "n", "unspecified", 2), (None, None, "output", 1)]
    assert (second.symbol, second.pins, second.error) == (None, [], None)
    assert rows["a/bad.sym"][0].error == "unbalanced" and rows["a/bytes.sym"][0].error == "not_utf8" and rows["a/deep.sym"][0].error == "too_deep"
    assert "a/empty.sym" not in rows and "a/null.sym" not in rows
