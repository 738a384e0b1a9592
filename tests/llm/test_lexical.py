"""Ranked search: many shards, blocks of items and odd rows against SQL and brute force; what MaxScore leaves out."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import lexical, sql

SCHEMA = "doc_id long, text string, term string, shard long, item_id long"


def by_sql(docs, items):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}))
    con.register("benchmark", pa.table({"item_id": pa.array([d for d, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}))
    return sorted(con.execute(sql.SQL["op13_maxscore_search"]).fetchall(), key=str)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA)
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, doc_id long")
    return sorted(map(tuple, lexical.search(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=600):
    random.seed(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÄB", "été", "x_y", "A1"]
    weights = [1 / (1 + i) for i in range(len(words))]
    text = lambda k: " ".join(random.choices(words, weights, k=k))
    docs = [(i, text(random.randrange(1, 40))) for i in range(n)]
    docs += [(5000 + i, docs[3][1]) for i in range(5)] + [(None, docs[3][1]), (None, None), (9000, ""), (9001, None), (9002, " .,;"), (9003, text(20000)), (2, docs[2][1])]
    items = [(i, text(random.randrange(1, 12))) for i in range(40)] + [(100, docs[3][1]), (101, None), (102, "nowhere"), (None, "w1"), (103, "w1 w2"), (103, "w3"), (104, "W1 w1  w1")]
    return docs, items


@pytest.mark.parametrize("shard, pairs, step", [(1 << 14, 50_000, 512), (37, 60, 4)])
def test_search_against_sql(spark, monkeypatch, shard, pairs, step):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(lexical, "FIRST_STEP", step)
    docs, items = corpus(4)
    got, want = found(spark, docs, items), by_sql(docs, items)
    assert got == want and len(got) > 400
    assert any(r[2] is None for r in got)


def test_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    """With more terms than may be broadcast the joins shuffle; the rows are the same."""
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 5)
    docs, items = corpus(6, 200)
    assert found(spark, docs, items) == by_sql(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(1, 5)
    assert found(spark, [], items) == [] == found(spark, docs, [])
    assert found(spark, [(1, None)], items) == []


def test_lists_that_cannot_matter_are_not_read():
    """A frequent term of little weight is probed for few documents, and the result is the whole sum's."""
    rng = np.random.default_rng(3)
    n = 20000
    lists = []
    for share, top in ((0.9, 10), (0.8, 12), (0.5, 25), (0.01, 5000), (0.005, 9000)):
        docs = np.flatnonzero(rng.random(n) < share)
        gains = rng.integers(top // 2, top + 1, len(docs))
        lists.append((docs, gains, int(gains.max())))
    ids, missing, best = np.arange(n), np.zeros(n, bool), lexical.Best.none(10)
    seen = lexical.max_score(lists, n, ids, missing, best)
    total = np.zeros(n, np.int64)
    for docs, gains, _ in lists:
        total[docs] += gains
    want = np.lexsort((ids, -total))[:10]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == total[want].tolist()
    assert seen < 0.2 * sum(len(x[0]) for x in lists)
