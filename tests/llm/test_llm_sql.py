"""The queries with SQL give DuckDB's rows on whole tables."""

import os

import duckdb
import pytest
from test_queries import canonical

from auditloom.llm import queries, sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(sql.SQL[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    got = canonical(df.columns, df.collect())
    assert got[0] == want[0]
    assert got[1] == want[1]
