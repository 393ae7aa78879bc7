"""The driver contract on the smallest data, where it is present."""

import os

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


def test_contract(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import rows_of, views

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    views(con, ROOT)
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
