"""Review drafts hold every field with its evidence; rejected pages have none."""

import hashlib
import json

from pyspark.sql import functions as F

from partwise.operators import drafts
from partwise.plans import catalogue as registry  # loads the modules of queries, in order
from partwise.plans import components

SF = "/root/testdata/sf0.001"


def test_recipes_name_the_lines_of_their_pages(spark):
    rows = components.fragments(spark, SF, whole=True).where("p_partkey BETWEEN 120 AND 131").select("p_partkey", F.explode("x").alias("x")).select("p_partkey", "x.line", "x.f.*", "x.heading", "x.section").collect()
    brands = {r["p_partkey"]: r["brand"] for r in components.pages(spark, SF).collect()}
    for k in range(120, 132):
        fill = lambda v: v.replace("{k}", str(k)).replace("{brand}", brands[k]) if isinstance(v, str) else v  # noqa: B023, E731
        want = [(line, role, a, b, raw, heading, section) for line, role, a, b, raw, heading, section in (map(fill, row) for row in components.recipe_rows(components.SHAPES[k % 12]))]
        assert sorted((r["line"], r["role"], r["a"], r["b"], r["raw"], r["heading"], r["section"]) for r in rows if r["p_partkey"] == k) == sorted(want)


def every(value, name):
    """All values under a name, at any depth."""
    if isinstance(value, dict):
        assert list(value) == sorted(value)
        for key, own in value.items():
            yield from [own] if key == name else []
            yield from every(own, name)
    elif isinstance(value, list):
        for own in value:
            yield from every(own, name)


def test_drafts_are_whole(spark):
    from partwise.plans import quality

    known = {r["p_partkey"]: r for r in quality.evaluated(spark, SF).select("p_partkey", "route", "overall", "n_warning", "n_blocking", "n_mapped", "n_unmapped", "n_pins", "aliases", "category", "titles", "summaries", "features", "best_review").collect()}
    pages = {r["p_partkey"]: r["text"] for r in components.pages(spark, SF).collect()}
    rows = {r["p_partkey"]: r for r in registry.QUERIES["comp_draft"](spark, SF).collect()}
    assert set(rows) == set(known) and {k for k, r in rows.items() if r["error"]} == {k for k, r in known.items() if r["route"] == "reject"}
    assert {r["error"] for r in rows.values() if r["draft"] is None} == {drafts.REJECTED}
    for k, r in rows.items():
        if r["draft"] is None:
            continue
        d, q = json.loads(r["draft"]), known[k]
        assert r["draft"] == json.dumps(d, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        assert (d["quality_route"], d["quality_score_basis_points"], d["selected_category"], d["title"]["value"]) == (q["route"], q["overall"], q["category"], q["titles"][0])
        assert d["artifact"]["content_sha256"] == hashlib.sha256(pages[k].encode()).hexdigest() and d["artifact"]["byte_length"] == len(pages[k].encode())
        specs = d["module_specifications"]
        assert (sum(s["taxonomy_path"] is not None for s in specs), sum(s["taxonomy_path"] is None for s in specs), len(d["module_connection"]["pins"])) == (q["n_mapped"], q["n_unmapped"], q["n_pins"])
        assert [a["value"] for a in d["aliases"]] == q["aliases"] and [f["value"] for f in d["features"]] == q["features"] and (d["summary"] and d["summary"]["value"]) == next(iter(q["summaries"]), None)
        # as many warnings as the evaluator counts; none blocks; all evidence is among that of the page, with its lines as they stand there
        assert sum(i["severity"] == "warning" for i in d["review_warnings"]) == q["n_warning"] and not q["n_blocking"]
        assert len({i["code"] for i in d["review_warnings"]}) == len(d["review_warnings"])
        lines = pages[k].split("\n")
        for e in d["provenance"]:
            assert all(part.strip() in lines[int(e["selector"][5:-1]) - 1] for part in e["raw_text"].split(" | ")) if e["extraction_method"] != "link" else e["section"] == "Resources"
        for shown in [*every(d, "evidence"), *every(d, "source_evidence")]:
            assert all(e in d["provenance"] for e in shown) and len({json.dumps(e) for e in shown}) == len(shown)
        # symbols under review say why, and stand in order; internal components are those that aren't the part itself
        assert max((s["confidence_basis_points"] for s in d["symbols"] if s["status"] == "proposed"), default=None) == q["best_review"]
        assert all(bool(s["review_reasons"]) == (s["status"] == "proposed") and s["source_evidence"] for s in d["symbols"])
        assert [s["record_id"] for s in d["symbols"] if s["relation_type"] != "exact_component"] == [i["record_id"] for i in d["internal_electronic_components"]]
    assert any(d["draft"] and "quality.enrichment_conflict" in d["draft"] for d in rows.values())
