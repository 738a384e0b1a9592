"""Ranked lexical search by MaxScore: each item's best documents, shard by shard.

A shard is the documents that one task reads in a row, up to ``SHARD_DOCS`` of
them or ``SHARD_BYTES`` of text. Its index holds each term's postings: which documents
have the term, and how often. Only terms of items go on from there; their document
frequencies are summed over the shards and give the weights.

A shard's postings carry what each document would gain from its term, and the
largest gain is the term's upper bound. An item's terms are sorted by it. Terms
whose bounds together stay below the score of the item's ``k``-th best document so
far are not essential: no document gets in by them alone. Documents come from the
lists of the other terms; the lists of the rest are probed for those documents
only that can still qualify, from the largest bound down, and the search for a
document ends when all bounds left would not lift it to the k-th best. Shards of one
task share that score, and a shard's documents are taken in steps, so that it is
known early. Items are dealt into blocks, so a task holds ``BLOCK_PAIRS`` (item,
term) pairs or so, however many items there are.

Terms are the maximal matches of ``TERM``; only A-Z are lower-cased. Nulls: a null
text has no terms; an item without id takes no part; items of one id are one
item with all their terms. A document without id counts and ranks like any
other, behind equal scores. Repeated rows are documents of their own, equal
scores and ids are ranked in any order. Empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS, Scratch, join_by_size, map_arrow, small_batches

TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A shard ends with this many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 1 << 14, 1 << 23
#: (item, term) pairs in a block of items, about.
BLOCK_PAIRS = 50_000
#: Documents of a shard that are taken first; each next step takes twice as many.
FIRST_STEP = 512
#: Rows of postings in an Arrow batch.
PIECE = 1 << 14
NO_ID = np.int64(2**63 - 1)

_POSTINGS = "shard long, term string, n_docs long, n_terms long, docs binary, times binary"


class Shard:
    """Terms of the documents read so far; ``rows`` turns them into postings.

    Documents are numbered by id (those without last), so equal scores are ordered by number.
    """

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[bytes] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
        found = re.findall(TERM, raw)
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.terms += found
        self.bytes += len(raw)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def rows(self, shard: int) -> Iterator[dict]:
        """The row without term describes the documents: ids and sizes; then a row for each term."""
        ids = np.array([NO_ID if x is None else x for x in self.ids], np.int64)
        missing = np.array([x is None for x in self.ids])
        order = np.lexsort((ids, missing))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        sizes = np.array(self.sizes, np.int64)
        head = {"shard": [shard], "term": [None], "n_docs": [int((sizes > 0).sum())], "n_terms": [int(sizes.sum())], "docs": [ids[order].tobytes() + missing[order].tobytes()], "times": [sizes[order].tobytes()]}
        yield head
        if not self.terms:
            return
        coded = pa.array(self.terms, pa.large_binary()).dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).cast(pa.string())
        key = coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(place, sizes)
        key, times = np.unique(key, return_counts=True)
        term, doc = np.divmod(key, len(ids))
        edge = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])

        def cut(x: np.ndarray) -> list[bytes]:
            raw = x.astype("<i4").tobytes()
            return [raw[4 * a : 4 * b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

        yield {"shard": np.full(len(edge) - 1, shard), "term": names.take(pa.array(term[edge[:-1]])), "n_docs": np.diff(edge), "n_terms": np.add.reduceat(times, edge[:-1]), "docs": cut(doc), "times": cut(times)}


def postings(docs: DataFrame) -> DataFrame:
    """(shard, term, n_docs, n_terms, docs, times) of all documents and terms, made where the documents are read; a row a shard without term describes its documents."""
    fields = StructType.fromDDL(_POSTINGS)
    schema = to_arrow_schema(fields)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = Shard(), TaskContext.get().partitionId() << 32

        def rows() -> Iterator[pa.RecordBatch]:
            for out in now.rows(number):
                whole = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
                yield from (whole.slice(at, PIECE) for at in range(0, whole.num_rows, PIECE))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                now.add(doc_id, text.as_py())
                if now.full():
                    yield from rows()
                    now, number = Shard(), number + 1
        if now.ids:
            yield from rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


@dataclass
class Best:
    """An item's best documents so far: scores and ids (and whether the id is missing), best first."""

    k: int
    scores: np.ndarray
    ids: np.ndarray
    missing: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    @property
    def least(self) -> int:
        """A document must score this at least to get in."""
        return max(int(self.scores[-1]), 1) if len(self.scores) == self.k else 1

    def put(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.missing, missing)))
        first = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[first], ids[first], missing[first]


def max_score(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, ids: np.ndarray, missing: np.ndarray, best: Best) -> int:
    """Put into ``best`` what a shard adds to it; the number of postings looked at.

    ``lists`` holds each term's documents, gains and largest gain.
    """
    lists = sorted(lists, key=lambda x: x[2])
    bound = np.cumsum([x[2] for x in lists])
    low, step, seen = 0, FIRST_STEP, 0
    while low < n_docs:
        high = min(low + step, n_docs)
        # the lists before this one cannot lift a document to the k-th best on their own
        essential = int(np.searchsorted(bound, best.least))
        if essential == len(lists):
            return seen
        score = np.zeros(high - low, np.int64)
        for docs, gains, _ in lists[essential:]:
            a, b = np.searchsorted(docs, (low, high))
            score[docs[a:b] - low] += gains[a:b]
            seen += int(b - a)
        found = np.flatnonzero(score)
        score = score[found]
        for t in range(essential - 1, -1, -1):
            can = score + bound[t] >= best.least
            found, score = found[can], score[can]
            if not len(found):
                break
            docs, gains, _ = lists[t]
            at = np.minimum(np.searchsorted(docs, found + low), len(docs) - 1)
            score = score + np.where(docs[at] == found + low, gains[at], 0)
            seen += len(found)
        good = score >= best.least
        if good.any():
            found = found[good] + low
            best.put(score[good], ids[found], missing[found])
        low, step = high, 2 * step
    return seen


def _best_of(rows: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best of all shards that a task holds, from rows sorted by block and shard, each shard's documents first."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        lists: dict[int, list] = {}
        now, ids, missing, length = (None, None), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

        def finish() -> None:
            for item, own in lists.items():
                max_score(own, len(ids), ids, missing, best.setdefault(item, Best.none(k)))
            lists.clear()

        def result() -> pa.RecordBatch:
            size = [len(x.ids) for x in best.values()]
            ids, missing, scores = (np.concatenate([getattr(x, name) for x in best.values()]) for name in ("ids", "missing", "scores"))
            out = [pa.array(np.repeat(np.array(list(best), np.int64), size)), pa.array(ids, mask=missing), pa.array(scores)]
            best.clear()
            return pa.RecordBatch.from_arrays(out, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["shard"]) != now:
                    finish()
                    if row["block"] != now[0] and best:
                        yield result()
                    now = row["block"], row["shard"]
                if row["term"] is None:
                    size = len(row["times"]) // 8
                    ids, missing = np.frombuffer(row["docs"], np.int64, size), np.frombuffer(row["docs"], bool, size, 8 * size)
                    length = 100 - 90 + 90 * np.frombuffer(row["times"], np.int64) * n_docs // max(n_terms, 1)
                    continue
                docs, times = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["times"], "<i4").astype(np.int64)
                gains = row["weight"] * (1_000_000_000 * times // (1000 * times + 8 * length[docs]))
                for item in row["items"]:
                    lists.setdefault(item, []).append((docs, gains, int(gains.max())))
        finish()
        if best:
            yield result()

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")

    def terms(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [sorted(set(re.findall(TERM, (x or "").encode("utf-8", "surrogatepass").lower()))) for x in batch.column("text").to_pylist()]
        ids = np.repeat(batch.column("item_id").to_numpy(), [len(x) for x in found])
        yield {"item_id": ids, "term": pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())}

    asked = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    pairs = scratch.table(map_arrow(asked, terms, "item_id long, term string").distinct(), "pairs")
    wanted = scratch.table(pairs.select("term").distinct(), "wanted")
    index = postings(docs)
    if wanted.count() <= BROADCAST_ROWS:  # other terms need not be written; beyond the bound they wait for the join below
        kept = wanted.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS term"))
        index = index.join(F.broadcast(kept), index["term"].eqNullSafe(kept["term"]), "left_semi")
    index = scratch.table(index, "index")
    heads, lists = index.where("term IS NULL"), index.where("term IS NOT NULL")
    n_docs, n_terms = heads.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    weight = F.floor(1000 * F.log((F.lit(2.0) * (n_docs or 0) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = lists.groupBy("term").agg(F.sum("n_docs").alias("df")).select("term", weight.alias("weight"))
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    sought = scratch.table(pairs.join(weights, "term").groupBy(block.alias("block"), "term", "weight").agg(F.collect_list("item_id").alias("items")), "sought")
    rows = join_by_size(lists, sought, ["term"]).select("block", "shard", "term", "docs", "times", "weight", "items")
    heads = heads.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "term", "docs", "times", F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("items"))
    dealt = heads.unionByName(rows).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())
    found = _best_of(dealt, int(n_docs or 0), int(n_terms or 0), k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
