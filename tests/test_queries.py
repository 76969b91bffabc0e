"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, open_tables

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = open_tables(FOLDER)
    c.execute("set timezone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    why, _a, _b = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert why == ""


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0
    assert out.columns == ["l_orderkey", "l_linenumber", "pc1", "pc2", "t2", "q", "outside"]
