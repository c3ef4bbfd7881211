"""Review drafts of component pages as canonical JSON: every field with its evidence, symbols, issues and digests.

A draft stands on the fragments of its page (lines that say something, in the
order of the page), its identity, the symbols that matching keeps, and its quality
report. Fields are in alphabetical order at every level, absent ones are null.
Rejected pages have no draft, only the error that composing them is. Evidence
stands in the order of the page; the digest of the input covers the page's text,
its identity and the symbols that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import compact_key, datasheet_tokens, identifier_tokens, interfaces, quantity, spaced_key
from partwise.operators import markup, quality, specs
from partwise.operators import matching as m

VERSION, REJECTED = "1.0.0", "composition_quality_rejected"
#: When pages were fetched and drafts composed: parameters of a run, since a query has no clock.
ACQUIRED_AT = COMPOSED_AT = "2000-01-01T00:00:00+00:00"
SOURCE_KEY, MEDIA_TYPE, SYMBOL_REVISION = "component_pages", "text/markdown", "r1"
#: How each role's fragments are found.
METHODS = {"title": "heading", "summary": "paragraph", "body": "paragraph", "feature": "list_item", "application": "list_item", "id": "label_value", "spec": "table_row", "pin": "table_row", "resource": "link", "image": "image"}
PIN_LABEL = "^(number of )?pins?( count)?$"
#: The dimension that each score of the evaluator stands for.
DIMENSIONS = {
    "identity": "identity_confidence", "description": "description_completeness", "specifications": "specification_coverage", "pinout": "module_pinout_presence", "provenance": "source_provenance_completeness",
    "conflicts": "conflicts", "enrichment": "enrichment_confidence", "educational": "educational_usefulness", "publication": "publication_readiness",
}
#: Rules of the matcher that may speak against a symbol under review: their names and what they say.
AGAINST = {"datasheet_conflict": ("matcher_datasheet_conflict_v1", "Datasheet identities disagree and require manual validation."), "interface_conflict": ("matcher_interface_conflict_v1", "Page and symbol state incompatible interface sets.")}
REASONS = {
    "internal": "Internal component relations require human review by policy.", "equivalent": "Functional equivalents are never accepted automatically.",
    "connector": "Connector relations require confirmation of the physical connector.", "generic": "Generic symbols require explicit human confirmation.", "inexact": "The candidate lacks an exact part-number match.",
    "against": "Negative evidence requires review: ", "few": "Auto-accept requires at least two independent source evidence fragments.",
}
#: What a profile's expectations ask for, in the order of ``quality.EXPECTED``.
WANTED = {
    "display": ["a communication interface", "display resolution"], "sensor": ["a measured quantity", "a measurement range"],
    "board": ["an MCU or primary IC", "power or supply-voltage data", "at least one communication interface"], "actuator": ["power or supply-voltage data", "a control interface"],
    "communication": ["a communication interface", "frequency or band data"],
}
#: Messages of the issues.
SAYS = {
    "identity": "The identity resolver requires manual review.", "half": "Only one of summary or detailed description is available.", "none": "The source does not provide usable summary or description content.",
    "specifications": "No structured specifications are available in the source.", "unmapped": "Some source specifications remain unmapped and require taxonomy review.",
    "pinout": "A module-level pinout is not available; symbol pins cannot replace it.", "revision": "The source has no immutable revision identifier.", "titles": "The extractor reported ambiguous_title.",
    "resolver": "The identity resolver reported ", "review": "One or more symbol relations require a reviewer decision.", "missing": "The source identifies a primary IC but no usable symbol relation was found.",
    "educational": "The source contains limited features, applications, usage or reference material.",
}
LEARNING = 600
#: Columns of the evaluator that drafts are composed of.
READS = [
    "revision", "status", "category", "kind", "aliases", "warnings", "profile", "specs", "ics", "expected", "has_summary", "has_description", "has_text", "described", "pinned", "wants_pins",
    "n_pins", "n_mapped", "n_unmapped", "n_extraction", "best_accepted", "best_review", *DIMENSIONS, "overall", "route",
]


def _struct(**fields: Column | str | int | bool | None) -> Column:
    """Fields by name; they must come in alphabetical order."""
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in fields.items()])


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _strings(*xs: str | Column) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]).cast("array<string>")


def _reviewed(confidence: str | Column, *codes: str) -> Column:
    return _struct(confidence=confidence, reason_codes=_strings(*codes), review_required=bool(codes))


def _shown(rows: Column) -> Column:
    return F.transform(rows, lambda x: x["e"])


def fragments(pages: DataFrame) -> DataFrame:
    """Pages with ``source`` and ``xs``: their fragments with tokens and evidence (of p_partkey, revision, x)."""
    source = _struct(source_key=SOURCE_KEY, source_path=F.concat(F.lit("pages/"), F.col("p_partkey"), F.lit(".md")), source_revision=F.col("revision"), source_url=F.lit(None).cast("string"))
    method = lambda role: F.coalesce(*[F.when(role == r, F.lit(name)) for r, name in METHODS.items()])
    evidence = lambda x: _struct(extraction_method=method(x["f"]["role"]), parser_version=VERSION, raw_text=x["f"]["raw"], section=x["heading"], selector=F.concat(F.lit("line["), x["line"], F.lit("]")), source=F.col("source"))
    one = lambda x: F.struct(x["line"], x["section"], x["heading"], x["f"]["role"].alias("role"), x["f"]["a"].alias("a"), x["f"]["b"].alias("b"), x["f"]["raw"].alias("raw"), identifier_tokens(x["f"]["raw"]).alias("tokens"), evidence(x).alias("e"))
    return pages.withColumn("source", source).withColumn("xs", F.transform("x", one)).drop("x")


def symbols(records: DataFrame) -> DataFrame:
    """What a draft shows of a symbol record, and what its evidence is found by (of the columns of ``matching.records``)."""
    c, empty = F.col, F.array().cast("array<int>")
    keys = F.filter(F.transform(F.concat(F.array("symbol"), "r_aliases"), compact_key), lambda k: k != "")
    numbers = F.when(c("pins") > 0, F.sequence(F.lit(1), c("pins"))).otherwise(empty)
    pins = F.transform(numbers, lambda n: _struct(electrical_type="passive", name=n.cast("string"), number=n.cast("string"), unit=1))
    return records.select(
        "record", "symbol", "library", c("words").alias("described"), c("datasheet").alias("sheet"), "filters", pins.alias("pinned"), F.array_distinct(keys).alias("keys"), m.is_generic(c("symbol")).alias("generic"),
        F.sha2(F.concat_ws(":", "library", "symbol", "record"), 256).alias("digest"),
    )


def _said(h: Column, *rules: str) -> Column:
    return F.exists(h["given"], lambda g: g["rule"].isin(*rules))


def _lines(h: Column) -> Column:
    """Numbers of the lines that the contributions of a hit rest on."""
    sheets = F.filter("xs", lambda x: (x["role"] == "resource") & F.contains(F.lower(x["a"]), F.lit("datasheet")))
    agrees = lambda x: (
        F.when(_said(h, "datasheet_exact"), m._place(x["b"]) == m._place(h["sheet"])).when(_said(h, "datasheet_identity"), F.arrays_overlap(datasheet_tokens(x["b"]), datasheet_tokens(h["sheet"])))
        .when(_said(h, "datasheet_domain"), m._host(x["b"]) == m._host(h["sheet"])).otherwise(_said(h, "datasheet_conflict"))
    )
    mentioned = F.transform(F.filter("xs", lambda x: (x["role"] != "image") & F.arrays_overlap(h["keys"], x["tokens"])), lambda x: x["line"])
    titled = F.when(_said(h, "canonical", "name", "description"), F.col("title_line"))
    maker = F.when(_said(h, "manufacturer_match", "manufacturer_conflict"), F.col("maker_line"))
    package = F.when(_said(h, "package_match", "package_conflict"), F.col("package_line"))
    pins = F.when(_said(h, "pins_match", "pins_conflict"), F.col("pins_line"))
    faces = F.when(_said(h, "interface_match", "interface_conflict"), F.col("face_lines")).otherwise(F.array().cast("array<bigint>"))
    return F.concat(mentioned, faces, F.array_compact(F.array(titled, maker, package, pins, F.get(F.filter(sheets, agrees), F.lit(0))["line"])))


def _of_rule(h: Column, rule: Column) -> Column:
    """Evidence of a rule that speaks against a symbol."""
    sheet = F.slice(F.filter("xs", lambda x: (x["role"] == "resource") & F.contains(F.lower(x["a"]), F.lit("datasheet"))), 1, 1)
    return _shown(F.when(rule == "datasheet_conflict", sheet).otherwise(F.filter("xs", lambda x: F.array_contains("face_lines", x["line"]))))


def _reasons(h: Column) -> Column:
    """Why a kept symbol needs a reviewer; none for an accepted one."""
    against = F.transform(F.filter(h["given"], lambda g: g["weight"] < 0), lambda g: F.coalesce(*[F.when(g["rule"] == r, F.lit(REASONS["against"] + text)) for r, (_, text) in AGAINST.items()]))
    low = F.concat(F.lit("Confidence 0."), F.lpad(h["score"].cast("string"), 3, "0"), F.lit(f" is below auto-accept threshold 0.{m.ACCEPT}."))
    agreed = F.size(F.filter(h["given"], lambda g: (g["weight"] > 0) & ~g["rule"].isin(*m.BASES, "mention", "canonical")))
    proofs = F.size(F.filter("xs", lambda x: (x["role"] != "image") & F.arrays_overlap(h["keys"], x["tokens"]))) + agreed
    exact = h["basis"] == "exact"
    first = _strings(
        F.when(h["relation"].isin("main_integrated_circuit", "onboard_component"), REASONS["internal"]), F.when(h["relation"] == "functional_equivalent", REASONS["equivalent"]),
        F.when(h["relation"] == "connector", REASONS["connector"]), F.when(h["generic"], REASONS["generic"]), F.when(~exact, REASONS["inexact"]),
    )
    last = _strings(F.when(h["score"] < m.ACCEPT, low), F.when((h["relation"] == "exact_component") & exact & (proofs < 2), REASONS["few"]))
    return F.when(h["decision"] == "review", F.array_compact(F.concat(first, against, last))).otherwise(_strings())


def _issue(when: Column, dimension: str, code: str | Column, warning: bool | Column, cause: str | Column, message: str | Column, evidence: Column | None = None) -> Column:
    """An issue where the condition holds, else null; what it is sorted by comes first."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    severity = F.when(lit(warning), "warning").otherwise("suggestion")
    shown = _shown(F.slice("xs", 1, 0)) if evidence is None else evidence
    return F.when(when, F.struct(F.when(lit(warning), 1).otherwise(2).alias("order"), F.lit(DIMENSIONS[dimension]).alias("dimension"), lit(code).alias("code"), lit(cause).alias("cause"), shown.alias("evidence"), lit(message).alias("message"), severity.alias("severity")))


def issues() -> Column:
    """The issues of a page that isn't rejected: warnings first, then by dimension and code."""
    c = F.col
    spoken = lambda pattern: _shown(F.filter("xs", lambda x: (x["role"] != "image") & F.lower(x["raw"]).rlike(pattern)))
    title = _shown(F.filter("xs", lambda x: x["line"] == c("title_line")))
    titles = _shown(F.filter("xs", lambda x: x["role"] == "title"))
    cause = lambda seen: F.when(seen, "extraction_missing").otherwise("source_missing")
    unmet = []
    for profile, rows in quality.EXPECTED.items():
        for n, (code, pattern, _) in enumerate(rows):
            e = F.get("expected", F.lit(n))
            unmet.append(_issue((c("profile") == profile) & ~e["met"], "specifications", code, e["in_source"], cause(e["in_source"]), f"The {profile} profile is missing {WANTED[profile][n]}.", spoken(pattern)))
    unmapped = _shown(F.transform(F.filter("told", lambda s: s["path"].isNull()), lambda s: s["x"]))
    own = F.array_compact(F.array(
        _issue(c("status") == "review", "identity", "quality.identity_review_required", True, "policy", SAYS["identity"], title),
        _issue(~(c("has_summary") & c("has_description")), "description", "quality.description_incomplete", c("described"), cause(c("described")), F.when(c("has_text"), SAYS["half"]).otherwise(SAYS["none"]), spoken(quality.DESCRIBED)),
        *unmet,
        _issue((F.size("expected") == 0) & (c("n_mapped") == 0), "specifications", "quality.specifications_source_missing", False, "source_missing", SAYS["specifications"]),
        _issue(c("n_unmapped") > 0, "specifications", "quality.unmapped_specifications", True, "extraction_missing", SAYS["unmapped"], unmapped),
        _issue(c("wants_pins") & (c("n_pins") == 0), "pinout", "quality.module_pinout_missing", c("pinned"), cause(c("pinned")), SAYS["pinout"], spoken(quality.PINNED)),
        _issue(c("revision").isNull(), "provenance", "quality.source_revision_missing", True, "source_missing", SAYS["revision"]),
        _issue(c("n_extraction") > 0, "conflicts", "quality.extraction_warning.ambiguous_title", True, "extraction_missing", SAYS["titles"], titles),
        _issue(c("best_accepted").isNull() & c("best_review").isNotNull(), "enrichment", "quality.enrichment_review_required", True, "policy", SAYS["review"], _shown(F.filter("xs", lambda x: F.exists("hits", lambda h: F.array_contains(h["lines"], x["line"]))))),
        _issue(c("best_accepted").isNull() & c("best_review").isNull() & (F.size("ics") > 0), "enrichment", "quality.expected_enrichment_missing", True, "source_missing", SAYS["missing"], _shown(F.filter("xs", lambda x: F.array_contains("ic_lines", x["line"])))),
        _issue(c("educational") < LEARNING, "educational", "quality.educational_content_limited", False, "source_missing", SAYS["educational"]),
    ))
    resolver = F.transform("warnings", lambda w: _issue(F.lit(True), "conflicts", F.concat(F.lit("quality.identity_warning."), w), True, "policy", F.concat(F.lit(SAYS["resolver"]), w, F.lit(".")), title))
    name = lambda rule: F.coalesce(*[F.when(rule == r, F.lit(n)) for r, (n, _) in AGAINST.items()])
    text = lambda rule: F.coalesce(*[F.when(rule == r, F.lit(t)) for r, (_, t) in AGAINST.items()])
    against = lambda h: F.transform(F.filter(h["given"], lambda g: g["weight"] < 0), lambda g: _issue(F.lit(True), "conflicts", F.concat_ws(".", F.lit("quality.enrichment_conflict"), h["id"], h["relation"], name(g["rule"])), True, "conflict", text(g["rule"]), _of_rule(h, g["rule"])))
    opposed = F.flatten(F.transform(F.filter("hits", lambda h: h["decision"] == "review"), against))
    return F.transform(F.sort_array(F.concat(own, resolver, opposed)), lambda i: F.struct(i["cause"], i["code"], i["dimension"], i["evidence"], i["message"], i["severity"]))


def composed(pages: DataFrame, ic_labels: list[str], package_labels: list[str], mention: str) -> DataFrame:
    """(p_partkey, draft) of evaluated pages that aren't rejected, with ``content`` and ``bytes`` of their text, ``xs``, ``source`` and ``hits`` beside the evaluator's columns.

    A hit: id, relation, basis, given, score, decision and the columns of ``symbols``, in the order in which drafts show them.
    """
    c = F.col
    of = lambda *roles: F.filter("xs", lambda x: x["role"].isin(*roles))
    first = lambda rows: F.get(rows, F.lit(0))
    line = lambda test: first(F.filter("xs", test))["line"]
    row = lambda test: lambda x: (x["role"] == "spec") & test(spaced_key(x["a"]), x["b"])
    ics = F.filter("xs", lambda x: ((x["role"] == "spec") & spaced_key(x["a"]).isin(ic_labels)) | (x["role"].isin("summary", "body", "feature", "application") & x["a"].rlike(mention)))

    def told(x: Column, s: Column) -> Column:
        kind = F.coalesce(specs.definition(s["label"], c("profile"))["kind"], F.lit("text"))
        unit = F.when(~kind.isin(*specs.UNTYPED), quantity(s["value"])["unit"])
        return F.struct(x.alias("x"), s["path"].alias("path"), s["label"].alias("label"), s["value"].alias("value"), s["normalized"].alias("normalized"), unit.alias("unit"), (unit.isNotNull() | ((kind == "interface") & (F.size(interfaces(s["value"])) > 0))).alias("sure"))

    out = pages.withColumns({
        "title_line": first(of("title"))["line"], "maker_line": line(lambda x: (x["role"] == "id") & (x["a"] == "manufacturer")), "package_line": line(row(lambda label, _: compact_key(label).isin(package_labels))),
        "pins_line": line(row(lambda label, value: label.rlike(PIN_LABEL) & value.rlike("[0-9]"))), "ic_lines": F.transform(ics, lambda x: x["line"]), "told": F.zip_with(of("spec"), "specs", told),
    })
    out = out.withColumn("face_lines", F.transform(F.filter("told", lambda s: s["path"] == "communication.interface"), lambda s: s["x"]["line"]))
    out = out.withColumn("hits", F.transform("hits", lambda h: h.withField("lines", _lines(h)).withField("reasons", _reasons(h))))
    out = out.withColumn("issues", issues())

    kept = F.transform("hits", lambda h: _struct(confidence_basis_points=h["score"], decision=h["decision"], record_id=h["id"], relation_type=h["relation"]))
    identity = _struct(aliases=c("aliases"), category=c("category"), kind=c("kind"), status=c("status"))
    out = out.withColumn("input", F.sha2(_json(_struct(content_sha256=c("content"), enrichments=kept, identity=identity, profile=c("profile"), source=c("source"))), 256))
    codes = lambda dimension: F.transform(F.filter("issues", lambda i: i["dimension"] == dimension), lambda i: i["code"])
    dims = F.array(*[_struct(dimension=d, issue_codes=codes(d), score_basis_points=c(n).cast("int"), weight_basis_points=quality.WEIGHTS[n]) for n, d in DIMENSIONS.items()])
    report = _struct(dimensions=dims, evaluator_version=VERSION, input_sha256=c("input"), issues=c("issues"), overall_score_basis_points=c("overall"), profile=c("profile"), ready_threshold_basis_points=quality.READY, reject_threshold_basis_points=quality.REJECT, route=c("route"), schema_version="quality-report/v1")
    out = out.withColumn("report", F.sha2(_json(report), 256))

    plain = _reviewed("high")
    who = F.when(c("status") == "auto", plain).otherwise(_reviewed("medium", "composition.identity_review_required"))
    texts = lambda rows, value="a", review=plain: F.transform(rows, lambda x: _struct(evidence=F.array(x["e"]), review=review, value=x[value]))
    bearing = lambda v: F.filter("xs", lambda x: ((x["role"] == "title") & (x["a"] == v)) | ((x["role"] == "id") & (x["a"] == "model") & (x["b"] == v)))

    def sections(kind: str) -> Column:
        rows = F.filter("xs", lambda x: (x["role"] == "body") & (x["b"] == kind))
        within = lambda s: F.filter(rows, lambda x: x["section"] == s)
        return F.transform(F.array_distinct(F.transform(rows, lambda x: x["section"])), lambda s: _struct(body=F.array_join(F.transform(within(s), lambda x: x["a"]), "\n"), evidence=_shown(within(s)), heading=first(within(s))["heading"], review=plain))

    def specification(s: Column) -> Column:
        review = F.when(s["path"].isNull(), _reviewed("low", "composition.unmapped_specification")).when(s["sure"], plain).otherwise(_reviewed("low", "composition.normalization_low_confidence"))
        mapped = s["path"].isNotNull()
        return _struct(evidence=F.array(s["x"]["e"]), label=s["label"], raw_value=s["value"], review=review, taxonomy_path=s["path"], unit=F.when(mapped, s["unit"]), value=F.when(mapped, s["normalized"]).otherwise(s["value"]))

    shown = lambda h: _shown(F.filter("xs", lambda x: F.array_contains(h["lines"], x["line"])))
    state = lambda h: F.when(h["decision"] == "auto_accepted", "accepted").otherwise("proposed")
    internal = lambda h: _struct(confidence_basis_points=h["score"], evidence=shown(h), name=h["symbol"], record_id=h["id"], relation_type=h["relation"], review_reasons=h["reasons"], status=state(h))
    symbol = lambda h: _struct(
        confidence_basis_points=h["score"], datasheet=h["sheet"], description=h["described"], footprint_filters=h["filters"], library=h["library"], parser_version=VERSION, pinout_level="symbol", pins=h["pinned"],
        record_id=h["id"], relation_type=h["relation"], review_reasons=h["reasons"], source_content_sha256=h["digest"], source_evidence=shown(h), source_path=F.concat(h["library"], F.lit(".lib")), source_revision=SYMBOL_REVISION, status=state(h), symbol_name=h["symbol"],
    )
    draft = _struct(
        aliases=F.transform("aliases", lambda v: _struct(evidence=_shown(bearing(v)), review=who, value=v)), applications=texts(of("application")),
        artifact=_struct(acquired_at=ACQUIRED_AT, byte_length=c("bytes"), content_sha256=c("content"), media_type=MEDIA_TYPE, source=c("source")),
        composed_at=COMPOSED_AT, composer_version=VERSION, detailed_description=sections("description"), draft_status="review_draft", features=texts(of("feature")),
        input_sha256=F.sha2(_json(_struct(quality_input_sha256=c("input"), quality_report_sha256=c("report"))), 256),
        internal_electronic_components=F.transform(F.filter("hits", lambda h: h["relation"] != "exact_component"), internal),
        manufacturer=first(texts(F.filter("xs", lambda x: x["line"] == c("maker_line")), "b", who)),
        module_connection=_struct(instructions=sections("usage"), pins=F.transform(of("pin"), lambda x: _struct(evidence=F.array(x["e"]), function=F.split(x["raw"], r" \| ")[2], name=x["b"], number=x["a"]))),
        module_specifications=F.transform(F.concat(F.filter("told", lambda s: s["path"].isNotNull()), F.filter("told", lambda s: s["path"].isNull())), specification),
        provenance=_shown(c("xs")), quality_report_sha256=c("report"), quality_route=c("route"), quality_score_basis_points=c("overall"),
        resources=F.transform(of("resource"), lambda x: _struct(evidence=F.array(x["e"]), kind=markup.resource_kind(x["a"], x["b"]), label=x["a"], locator=x["b"])),
        review_warnings=c("issues"), schema_version="review-draft/v1", selected_category=c("category"), summary=first(texts(of("summary"))), symbols=F.transform("hits", symbol), title=first(texts(of("title"), "a", who)),
    )
    return out.select("p_partkey", _json(draft).alias("draft"))
