"""Every query with SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SQL = {k: v for k, v in entry.oracle_sql().items() if not (k.startswith("op") and k[2].isdigit()) and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    return str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(SQL[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    got = canonical(df.columns, df.collect())
    assert got[0] == want[0]
    assert got[1] == want[1]
