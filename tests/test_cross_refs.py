"""Suppliers that share parts, over the whole of lineitem, against brute force."""

import os
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow.parquet as pq

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def brute(part, supplier):
    by_part = defaultdict(set)
    for p, s in zip(part, supplier, strict=True):
        by_part[p].add(s)
    n = Counter(pair for suppliers in by_part.values() for pair in combinations(sorted(suppliers), 2))
    return {(a, b, c) for (a, b), c in n.items() if c >= 2}


def test_whole_table(spark):
    rows = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_partkey", "l_suppkey"])
    want = brute(*(c.to_pylist() for c in rows.columns))
    got = [tuple(r) for r in entry.queries()["cross_refs"](spark, SF).select("l_suppkey", "other", "shared_parts").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_small_quantities_and_repeated_lines_count_once(spark, tmp_path):
    rows = [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 44.0), (2, 2, 2.0), (2, 2, 2.0), (3, 3, 50.0), (3, 1, 50.0), (3, 1, 50.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in entry.queries()["cross_refs"](spark, str(tmp_path)).select("l_suppkey", "other", "shared_parts").collect()]
    assert got == [(1, 2, 2)]
