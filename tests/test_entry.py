from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from permitflow import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, str | bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, int | float) else str(v)[:10]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_only_queries(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.SQL)):
        assert queries.QUERIES[name](spark, SF).count() > 0, name


def test_identifiers_where_an_order_has_its_priority_s_number(spark, duck):
    """Order 2 of sf0.01 is 2-HIGH; the smallest tables have no such row."""
    at = "/root/testdata/sf0.01"
    df = queries.QUERIES["identifiers"](spark, at)
    want = duck.execute(queries.SQL["identifiers"].replace("from orders", f"from '{at}/orders.parquet'")).fetchall()
    cols = [d[0] for d in duck.description]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)
