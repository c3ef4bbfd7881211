import hashlib

import pytest

from partwise.llm.common import read
from partwise.llm.queries import op3_arc_to_warc
from partwise.llm.warc import _arc_version_block, arc_records, through_archives

SF = "/root/testdata/sf0.001"


def expected(rows):
    first, out = {}, []
    for i, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        if len(b) >= 100 and d in first:
            out.append((i, len(b), d, "revisit", first[d]))
        else:
            first.setdefault(d, i)
            out.append((i, len(b), d, "response", None))
    return sorted(out, key=repr)


def test_query_against_plain_version(spark):
    rows = [(r["page_id"], r["html"]) for r in read(spark, SF, "pages").collect()]
    assert sorted(map(tuple, op3_arc_to_warc(spark, SF).collect()), key=repr) == expected(rows)


def test_awkward_pages(spark):
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(4, "u", big), (2, None, big), (2, "http://a b/\n", big), (9, "u", None), (None, "u", big), (7, "u", ""), (8, "u", "short"), (6, "u", "short"), (11, "http://é/", "é" * 60)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in through_archives(df).collect()]
    assert sorted(got, key=repr) == expected([(i, h) for i, _, h in rows])


def test_empty(spark):
    assert through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_both_arc_versions_and_faults():
    for version, extra in ((1, ""), (2, " 200 - - 0 f")):
        data = _arc_version_block(version, "f.arc", "20240101000000") + f"\nhttp://x/ 0.0.0.0 20240101000000 text/html{extra} 5\n".encode() + b"a\nb\nc\n"
        ((fields, block),) = arc_records(data)
        assert fields["URL"] == "http://x/" and block == b"a\nb\nc"
    with pytest.raises(ValueError, match="shorter"):
        list(arc_records(data[:-4]))


def test_record_fields(spark):
    df = spark.createDataFrame([(1, "http://x/y", "p" * 300)], "page_id long, url string, html string")
    row = through_archives(df).first()
    assert row["warc_date"] == "2024-01-01T00:00:00Z" and row["record_id"].startswith("<urn:uuid:") and row["target_uri"] == "http://x/y"
