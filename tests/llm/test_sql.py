"""Operator queries against their SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from permitflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    order = [d[0] for d in cur.description]
    assert sorted(df.columns) == cols
    want = sorted(tuple(str(r[order.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want
