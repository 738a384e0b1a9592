"""Recall of the collision search on vectors of unequal length, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import ann

N, DIM, K = 6400, 64, 20


def vectors(kind):
    rng = np.random.RandomState(11)
    v = rng.standard_normal((N, DIM))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if kind == "log-normal":
        v *= rng.lognormal(0, 0.5, N)[:, None]
    if kind == "one longer":
        v[7] *= 5
    if kind == "tiny":
        v *= rng.lognormal(0, 0.5, N)[:, None] * 1e-170
    return v


@pytest.mark.parametrize("kind", ["unit", "log-normal", "one longer"])
def test_recall_does_not_hang_on_lengths(spark, kind):
    v = vectors(kind)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(N), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float64()))}))
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), K).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(range(0, N, 100))
    hits = 0
    for q, found in got.items():
        scores = v @ v[q]
        scores[q] = -np.inf
        assert len(found) == K
        hits += len(found & set(np.argsort(-scores)[:K]))
    assert hits / (K * len(got)) >= 0.95


def test_lengths_whose_squares_are_zero():
    v = vectors("tiny")
    found = list(ann.Shard(np.arange(N), v).search(v[:3] * 1e170, np.arange(3), K))
    assert [i for i, *_ in found] == [0, 1, 2] and all(len(ids) == K and i not in ids for i, ids, _ in found)


@pytest.mark.parametrize("shard_rows, n", [(16384, 500), (700, 3000)])
def test_small_and_several_shards_and_blocks(spark, monkeypatch, shard_rows, n):
    """Bands of any size are searched by collisions; several shards and blocks of queries give each query one answer."""
    monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    v = vectors("log-normal")[:n]
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float64()))}))
    rows = ann.search(df, df.where("vec_id % 20 = 0"), K).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert r["score"] == pytest.approx(float(v[r["query_id"]] @ v[r["vec_id"]]))
    hits = 0
    for q in range(0, n, 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        assert sorted(got[q]) == list(range(1, K + 1)) and q not in got[q].values()
        hits += len(set(got[q].values()) & set(np.argsort(-scores)[:K]))
    assert hits / (K * len(got)) >= 0.95
