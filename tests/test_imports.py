"""Every module imports first in a fresh process; long titles and large snapshots stay whole."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted(".".join(p.relative_to(ROOT).with_suffix("").parts) for p in (ROOT / "partwise").rglob("*.py") if p.name != "__init__.py" and "llm" not in p.parts)


def test_each_module_imports_on_its_own():
    code = "import importlib, sys\nfor name in sys.argv[1:]:\n    for m in [m for m in sys.modules if m.startswith('partwise')]: del sys.modules[m]\n    importlib.import_module(name)"
    done = subprocess.run([sys.executable, "-c", code, *MODULES], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize(("n", "verdict"), [(9_999, "ok"), (10_500, "too_many_files")])
def test_snapshot_counts_all_files(spark, n, verdict):
    import duckdb

    from partwise.plans import catalogue, scans

    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/en/"), F.col("id")).alias("url"), F.concat(F.lit("<p>"), F.col("id")).alias("html"))
    got = scans.snapshot(pages.repartition(5)).toArrow()
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = con.execute(catalogue.ORACLE["src_snapshot"]).to_arrow_table()
    order = [("page_id", "ascending")]
    assert got.sort_by(order).to_pylist() == want.sort_by(order).select(got.column_names).to_pylist()
    assert set(got.column("verdict").to_pylist()) == {verdict} and (got.column("revision").null_count == n) == (n > 10_000)


def test_long_titles_stay_whole(spark, monkeypatch):
    from partwise.plans import components

    title = "Long " * 1000 + "end"
    text = "\n".join([f"# {title}", *[f"# Alias {i}" for i in range(1500)], "A summary."])
    monkeypatch.setattr(components, "pages", lambda spark, sf_dir: spark.createDataFrame([(1, "b", 0, "r1", text)], "p_partkey long, brand string, shape int, revision string, text string"))
    titles = components.facts(spark, "").first().titles
    assert titles[0] == title and len(titles) == 1501


def test_snapshots_of_any_size_are_digested_whole(spark):
    """Of more files than the limit, too, every file is in the digest of all."""
    import hashlib

    from partwise.plans import scans

    n, sha = 10_500, lambda text: hashlib.sha256(text.encode()).hexdigest()
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/en/"), F.col("id")).alias("url"), F.concat(F.lit("<p>"), F.col("id")).alias("html"))
    groups = [sha(",".join(f"{i}:{sha(f'<p>{i}')}" for i in range(g, n, 64))) for g in range(64)]
    got = scans.snapshot(pages.repartition(5)).select("files_sha256").distinct().collect()
    assert [r["files_sha256"] for r in got] == [sha(",".join(f"{g}:{d}" for g, d in enumerate(groups)))]
