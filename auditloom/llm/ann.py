"""Approximate nearest neighbours by collision counting over sorted projections.

Each of ``PROJECTIONS`` random directions gives one sorted array of projected
values. A query's window in each array is centred on its own projection and
grows by virtual rehashing: the radius is multiplied, only what the growth adds
is counted. Vectors that fall into enough windows are candidates and their
measure is computed exactly, in double precision, on the original vectors.

Nearness is the inner product: a vector gets one more coordinate that brings all
to the largest length, the query is scaled to that length, so the nearest by
distance have the largest product. A shard is cut by length into bands, each
with its own largest length and arrays, and searched from the longest down. A
band is left when a vector of the k-th best product so far would be a candidate
with probability ``FOUND`` at the radius reached; the rest are left when query
and largest length together bound every product below the k-th best. Bands of
few vectors are computed whole.

The index is cut into shards of at most ``SHARD_ROWS`` vectors; blocks of queries meet every shard. Equal vectors of a shard are one
entry that keeps its ids in order. Results are merged by query, best first.

Nulls: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without id. Vectors of another dimension than the
query's are not compared with it. Repeated ids are rows of their own; a query is
never its own neighbour by id. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch

PROJECTIONS, SHARD_ROWS, BLOCK_ROWS = 64, 16384, 4096
#: Parts that the pairing of blocks and shards of one dimension is dealt into.
SPREAD = 64
#: A candidate falls into this share of the windows; the search of a band ends no sooner than so large a share of it, and so
#: many times the wanted vectors at least, are candidates. Vectors that point everywhere alike need shares like these for a recall of 0.9.
COLLISION_SHARE, CANDIDATE_SHARE, CANDIDATES = 0.85, 0.3, 20
#: Entries from which a query's first radius is guessed, and what a radius is multiplied by when the windows hold too few.
GUESS_ROWS, GROWTH = 256, 1.06
#: A band holds lengths down to this share of its longest, and so many vectors at least.
BAND_SHARE, BAND_ROWS, FOUND = 0.8, 800, 0.95


def directions(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.RandomState(20 + dim).standard_normal((dim + 1, count)) / np.sqrt(dim)


def reach_of(count: int, enough: int, found: float = FOUND) -> float:
    """Radius, in standard deviations of a projected distance, at which ``enough`` of ``count`` windows hold a vector with probability ``found``."""
    low, high = 0.0, 10.0
    for _ in range(60):
        z = (low + high) / 2
        p = math.erf(z / math.sqrt(2))
        if sum(math.comb(count, j) * p**j * (1 - p) ** (count - j) for j in range(enough, count + 1)) < found:
            low = z
        else:
            high = z
    return high


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Lengths of vectors that are not zero, without overflow or underflow of the squares."""
    scale = np.abs(vectors).max(axis=1)
    return scale * np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1))


class Band:
    """Vectors of like length, with the sorted arrays."""

    def __init__(self, first: int, vectors: np.ndarray, lengths: np.ndarray):
        self.first, self.vectors, self.longest = first, vectors, float(lengths[0])
        extra = self.longest * np.sqrt(1 - (lengths / self.longest) ** 2)[:, None]
        projected = np.hstack([vectors, extra]) @ directions(vectors.shape[1])
        order = np.argsort(projected, axis=0, kind="stable")
        self.values = np.take_along_axis(projected, order, axis=0).T.copy()
        self.order = order.T.copy()
        self.guess = projected[np.linspace(0, len(projected) - 1, min(len(projected), GUESS_ROWS)).astype(np.int64)]

    def candidates(self, own: np.ndarray, need: int, enough: int) -> Iterator[tuple[np.ndarray, float]]:
        """(entries, radius) for ever larger radii, with ``need`` entries at least; a radius that is sent is the least of the next step."""
        n, m = len(self.vectors), len(self.values)
        reach = np.sort(np.partition(np.abs(self.guess - own), enough - 1, axis=1)[:, enough - 1])
        r = max(float(reach[min(len(reach) - 1, need * len(reach) // n)]), 1e-9 * self.longest, 1e-300)
        counts = None
        low = high = [int(v.searchsorted(q)) for v, q in zip(self.values, own, strict=True)]
        while True:
            to_low = [int(v.searchsorted(q - r, "left")) for v, q in zip(self.values, own, strict=True)]
            to_high = [int(v.searchsorted(q + r, "right")) for v, q in zip(self.values, own, strict=True)]
            if counts is None and 2 * (sum(to_high) - sum(to_low)) > n * m:  # fewer entries lie outside the windows
                outside = [o[:a] for o, a in zip(self.order, to_low, strict=True)] + [o[b:] for o, b in zip(self.order, to_high, strict=True)]
                counts = m - np.bincount(np.concatenate(outside), minlength=n)
            else:
                new = [o[a:b] for o, a, b in zip(self.order, to_low, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, to_high, strict=True)]
                counts = np.bincount(np.concatenate(new), minlength=n) + (0 if counts is None else counts)
            low, high = to_low, to_high
            found = np.flatnonzero(counts >= enough)
            least = (yield found, r) if len(found) >= need else None
            r = max(r * GROWTH, least or 0.0)


class Shard:
    """Distinct vectors of one dimension, longest first, their ids, and the bands."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
        _, first, of = np.unique(raw, return_index=True, return_inverse=True)
        lengths = lengths_of(vectors[first])
        by_length = np.argsort(-lengths, kind="stable")
        self.vectors, lengths = vectors[first][by_length], lengths[by_length]
        of = np.argsort(by_length)[of]
        by_entry = np.argsort(of, kind="stable")
        self.ids, self.start = ids[by_entry], np.concatenate([[0], np.cumsum(np.bincount(of))])
        self.bands, at = [], 0
        while at < len(lengths):
            end = max(at + BAND_ROWS, int(np.searchsorted(-lengths, -BAND_SHARE * lengths[at], "right")))
            self.bands.append(Band(at, self.vectors[at:end], lengths[at:end]))
            at = end

    def _best(self, entries: np.ndarray, band: Band, query: np.ndarray, length: float, query_id: int, k: int, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of what is known and of the band's ``entries``, ties to the smaller id. Quick products choose whose exact measure is computed."""
        if len(entries) > 2 * k:
            quick = (band.vectors @ query)[entries] if 4 * len(entries) > len(band.vectors) else band.vectors[entries] @ query
            least = np.partition(quick, len(quick) - k - 1)[len(quick) - k - 1]  # the query itself may be one
            entries = entries[quick >= (max(least, values[-1]) if len(values) == k else least) - 1e-10 * length * band.longest]
        scores = (band.vectors[entries] * query).sum(axis=1)
        entries = entries + band.first
        if len(entries) > k + 1:  # entries with equal scores stay together
            some = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            entries, scores = entries[some], scores[some]
        if not len(entries):
            return ids, values
        new = [self.ids[self.start[e] : min(self.start[e] + k + 1, self.start[e + 1])] for e in entries]
        flat, value = np.concatenate(new), np.repeat(scores, [len(x) for x in new])
        other = flat != query_id
        ids, values = np.concatenate([ids, flat[other]]), np.concatenate([values, value[other]])
        best = np.lexsort((ids, -values))[:k]
        return ids[best], values[best]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's row, ids, scores) with the best ``k`` found here."""
        dim = queries.shape[1]
        lengths = lengths_of(queries)
        own = np.hstack([queries / lengths[:, None], np.zeros((len(queries), 1))]) @ directions(dim)
        m = own.shape[1]
        enough = int(np.ceil(COLLISION_SHARE * m))
        z = reach_of(m, enough) / np.sqrt(dim)
        for i in range(len(queries)):
            ids, values = np.empty(0, np.int64), np.empty(0)
            for band in self.bands:
                n = len(band.vectors)
                if len(ids) == k and values[-1] > lengths[i] * band.longest * (1 + 1e-9):
                    break  # no product in this band or a shorter one is as large
                steps = band.candidates(own[i] * band.longest, min(n, max(CANDIDATES * k, int(CANDIDATE_SHARE * n))), enough)
                found, r = next(steps)
                known = np.zeros(n, bool)
                while True:
                    new = found[~known[found]]
                    if len(new):
                        ids, values = self._best(new, band, queries[i], lengths[i], query_ids[i], k, ids, values)
                    known[new] = True
                    if len(found) == n:
                        break
                    least = 0.0
                    if len(ids) == k:
                        far = 2 * band.longest * max(band.longest - values[-1] / lengths[i], 0.0)  # square of the k-th best's distance
                        least = z * float(np.sqrt(far))
                        if r >= least:
                            break
                    found, r = steps.send(least)
            yield i, ids, values


def _packed(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (id, vector) packed into (dim, ids, vectors) of at most ``limit`` rows, bytes of int64 and float64."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(vectors, np.float64).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_numpy(zero_copy_only=False), strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == limit:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, ids binary, vectors binary")


def usable(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists("vector", lambda x: x != 0)
    return table.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & whole & some)


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows found, nearest first, ties to the smaller id."""
    spark = table.sparkSession
    rows = usable(table, id_column, vector)
    scratch = Scratch(spark, "ann")
    # shards are of one size whatever the shuffle's partitions: what a query finds grows with the vectors alone
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    index = scratch.table(_packed(rows.repartition(shards), SHARD_ROWS).withColumn("shard", F.monotonically_increasing_id()), "index")
    asked = usable(queries, id_column, vector)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    packed = _packed(asked.repartition(blocks), BLOCK_ROWS).withColumnsRenamed({"dim": "query_dim", "ids": "query_ids", "vectors": "query_vectors"})
    packed = packed.withColumn("block", F.monotonically_increasing_id())
    packed = scratch.table(packed, "blocks")
    # a stated query set meets every shard of its dimension: numbers are paired by dimension and SPREAD remainders, then each block goes where the shard is
    ends = packed.select(F.col("query_dim").alias("dim"), "block", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    pairs = scratch.table(ends.join(index.select("dim", "shard", (F.col("shard") % SPREAD).cast("int").alias("part")), ["dim", "part"]).select("block", "shard"), "pairs")
    # a shard goes once to each group of blocks, its arrays are sorted there once, and the blocks follow
    groups = max(1, min(blocks, -(-spark.sparkContext.defaultParallelism // shards)))
    heads = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(None).cast("long").alias("block"), "dim", "ids", "vectors")
    asks = pairs.join(packed, "block").select("shard", (F.col("block") % groups).cast("int").alias("group"), "block", F.col("query_dim").alias("dim"), F.col("query_ids").alias("ids"), F.col("query_vectors").alias("vectors"))
    met = heads.unionByName(asks).repartition("shard", "group").sortWithinPartitions("shard", "group", F.col("block").asc_nulls_first())
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                if row["block"] is None:
                    shard = Shard(ids, vectors)
                    continue
                found = list(shard.search(vectors, ids, k))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[[i for i, *_ in found]], [len(x) for _, x, _ in found])),
                    pa.array(np.concatenate([x for _, x, _ in found])),
                    pa.array(np.concatenate([s for *_, s in found])),
                ], schema=schema)

    near = met.select("block", "dim", "ids", "vectors").mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
