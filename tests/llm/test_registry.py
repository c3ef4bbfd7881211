import os
import re

import pytest

from partwise.llm import queries


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    rows = lambda t: sorted((tuple(r[c] for c in sorted(t.column_names)) for r in t.to_pylist()), key=repr)
    got, want = queries.QUERIES[name](spark, sf).toArrow(), con.sql(queries.ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)
