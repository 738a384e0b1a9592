"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum: half the hash evaluations for a signature of the same length,
and less variance, as the two ends of one order seldom fall together. The values
are cut into bands; documents that share a band are candidates, and each
candidate link is confirmed on the full shingle sets.

Documents with equal sets are one class; only classes are banded. In a band's
bucket every member is first held against the bucket's smallest member. Only
members of buckets that still hold more than one component are looked at again,
and all sets of fewer than ``SMALL`` shingles, whose signatures say little: they
are paired across components by their rarest shingles, which leaves out no pair
that reaches the threshold. So a bucket of many copies costs one pair a copy.

Nulls: a null text has no words, an empty set and no links. Rows with a null
``doc_id`` take no part in linking: their component is null and they are not
kept. All texts of rows that share a ``doc_id`` are one component, with what any
of them is linked with. Texts of fewer than five words are one shingle. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_by_size, map_arrow, shingle_sets, small_batches, splitmix, text_batches
from .graph import components

SHINGLE, THRESHOLD = 5, 75
#: Bands of ROWS values. A pair of large sets at 0.75 shares none of them once in 60,000 times.
BANDS, ROWS = 56, 6
#: Sets of fewer shingles are paired exactly: of so few values minimum and maximum are not independent.
SMALL = 32
#: Partners that one task holds against a set at a time: a set with more is sent to several.
SLICE = 500


def signature(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """(set, value) minima and maxima of 32-bit hashes under ``permutations`` permutations; no set may be empty."""
    flat = np.concatenate(sets)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    seeds = splitmix(2024, 2 * permutations)
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    step = 1 << 15
    first = 0
    while first < len(sets):  # pieces that stay in the cache
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        x = (flat[offsets[first] : offsets[last]] >> np.uint64(32)).astype(np.uint32)
        at = offsets[first:last] - offsets[first]
        y = np.empty_like(x)
        for p in range(permutations):
            np.bitwise_xor(x, np.uint32(seeds[2 * p] >> np.uint64(32)), out=y)
            np.multiply(y, np.uint32(seeds[2 * p + 1] >> np.uint64(32) | np.uint64(1)), out=y)
            out[first:last, 2 * p] = np.minimum.reduceat(y, at)
            out[first:last, 2 * p + 1] = np.maximum.reduceat(y, at)
        first = last
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(set, band) 64-bit keys; band b's keys differ from all other bands'."""
    cut = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    factors = splitmix(77, bands * rows).reshape(bands, rows) | np.uint64(1)
    keys = (cut * factors).sum(axis=2, dtype=np.uint64) + splitmix(78, bands)
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (of the text), n (shingles), set_a and set_b (what the set hashes to) and bands of each row."""
    schema = "doc_id long, mark long, n long, set_a long, set_b long, bands array<long>"
    # a band never holds both ends of one permutation next to each other only: values alternate, min and max
    permutations = -(-bands * rows // 2)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, texts in text_batches(batch, "text", 1 << 19):
            sets = list(shingle_sets(texts, SHINGLE))
            full = [i for i, x in enumerate(sets) if len(x)]
            keys: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys(signature([sets[i] for i in full], permutations), bands, rows), strict=True):
                    keys[i] = row
            yield {
                "doc_id": batch.column("doc_id").slice(at, len(texts)),
                "mark": batch.column("mark").slice(at, len(texts)),
                "n": [len(x) for x in sets],
                "set_a": [int(x.sum(dtype=np.uint64).view(np.int64)) for x in sets],
                "set_b": [int(np.bitwise_xor.reduce(x * (x | np.uint64(1)) ^ (x >> np.uint64(17))).view(np.int64)) if len(x) else 0 for x in sets],
                "bands": keys,
            }

    return map_arrow(_marked(docs), work, schema)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))


def _texts(ids: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text) of the classes ``ids`` (node): the text of each one's first row, known by id and mark."""
    first = scratch.table(join_by_size(classes.select("node", "rep", "mark"), scratch.table(ids.distinct(), "ids"), ["node"], "left_semi"), "first")
    some = join_by_size(_marked(docs).withColumnRenamed("doc_id", "rep"), first.select("rep", "mark"), ["rep", "mark"], "left_semi")
    return scratch.table(some.dropDuplicates(["rep", "mark"]).join(first, ["rep", "mark"]).select("node", "text"), "texts")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= threshold * union.

    ``a``'s text is sent once for ``SLICE`` partners, whose texts follow it: no
    task holds all partners of one set, and no pair carries two texts.
    """
    pairs = scratch.table(pairs, "pairs")
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, docs, scratch)
    counts = scratch.table(pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / SLICE) + 1).cast("int").alias("slices")), "counts")
    sliced = join_by_size(pairs, counts, ["a"]).withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
    partners = sliced.join(texts.withColumnRenamed("node", "b"), "b").select("a", "slice", "b", "text")
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(texts.withColumnRenamed("node", "a"), "a")
    both = heads.select("a", "slice", F.lit(None).cast("long").alias("b"), "text").unionByName(partners)
    rows = both.repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = []
            for at, texts in text_batches(batch, "text", 1 << 19):
                for i, x in enumerate(shingle_sets(texts, SHINGLE), at):
                    if b[i] is None:
                        head, own = a[i], x
                    elif a[i] == head and len(x) and len(own):
                        merged = np.concatenate([x, own])
                        merged.sort()
                        shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                        if 100 * shared >= threshold * (len(x) + len(own) - shared):
                            found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in found], pa.int64()), pa.array([b[i] for i in found], pa.int64())], schema=schema)

    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long")


def rare_prefixes(rest: DataFrame, texts: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component, n, token, cap) of the rarest shingles of each set of ``rest`` (node, n, component), those that others have too.

    Two sets that reach the threshold share a shingle among the first n - ceil(t * n) + 1
    of each, in whatever common order; rare ones come first here, by counts of
    all of them. What stands before a shingle is lost for the overlap if it is the first
    shared one: a partner may have ``cap`` shingles at most.
    """

    def shingles(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("node").to_numpy()
        for at, piece in text_batches(batch, "text"):
            sets = list(shingle_sets(piece, SHINGLE))
            yield {"node": np.repeat(ids[at : at + len(piece)], [len(x) for x in sets]), "token": np.concatenate(sets).view(np.int64)}

    every = scratch.table(map_arrow(texts, shingles, "node long, token long"), "shingles")
    counts = scratch.table(every.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "times")
    own = Window.partitionBy("node")
    ranked = join_by_size(every, counts, ["token"]).select("node", "token", F.row_number().over(own.orderBy("times", "token")).alias("rank"), F.count("*").over(own).alias("shared"))
    # shingles of this set alone come first; they meet nobody
    placed = ranked.join(rest, "node").withColumn("place", F.col("n") - F.col("shared") + F.col("rank") - 1)
    first = placed.where(F.col("place") <= F.col("n") - F.expr(f"(n * {threshold} + 99) div 100"))
    return first.select("node", "component", "n", "token", F.expr(f"((n - place) * {100 + threshold}) div {threshold} - n").alias("cap"))


def prefix_cells(rest: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The cells (token, component, n, cap) of ``rest`` (node, n, component) that meet, in pairs x and y with the least node of each, and their members.

    Of a pair of sets that reaches the threshold, the one that is not larger has room for one of its own size
    at least (``cap``): of texts made from one template that differ too much, the
    common shingles stand too far back for that, so they meet in no pair. Sets of one
    component, size and cap are one cell of a token; cells are held against each
    other, so that members of one component never are. None is left out.
    """
    texts = _texts(rest.select("node"), classes, docs, scratch)
    rare = scratch.table(rare_prefixes(rest, texts, scratch, threshold), "rare")
    scratch.drop("shingles", "times")
    tokens = rare.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.col("cap") - F.col("n")).alias("room"))
    tokens = scratch.table(tokens.where("low <> high AND room >= 0").select("token"), "tokens")
    rare = scratch.table(join_by_size(rare, tokens, ["token"], "left_semi"), "rare")
    cells = scratch.table(rare.groupBy(*_CELL).agg(F.min("node").alias("node")), "cells")
    fits = F.expr(f"component_x <> component_y AND n_x <= n_y AND (n_x < n_y OR component_x < component_y) AND n_y <= cap_x AND n_x <= cap_y AND n_x * 100 >= n_y * {threshold}")
    return scratch.table(_side(cells.where("cap >= n"), "x").join(_side(cells, "y"), "token").where(fits), "meet"), rare


_CELL = ["token", "component", "n", "cap"]


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select("token", *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "token"))


def _pairs(meet: DataFrame) -> DataFrame:
    return meet.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def cell_pairs(meet: DataFrame, rare: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of all members of two cells that meet and that ``groups`` (node, component) has not joined yet."""
    now = lambda side: F.coalesce(f"now_{side}", f"component_{side}")
    for side in "xy":
        meet = meet.join(groups.select(F.col("node").alias(f"node_{side}"), F.col("component").alias(f"now_{side}")), f"node_{side}", "left")
    left = meet.where(now("x") != now("y")).drop("node_x", "node_y", "now_x", "now_y")
    for side in "xy":
        left = left.join(_side(rare, side), ["token", *(f"{c}_{side}" for c in _CELL[1:])])
    return _pairs(left)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and mark (of the text), a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.table(signatures(docs, bands, rows), "signed")
    slim = scratch.table(signed.drop("bands"), "slim")
    sets = slim.where("n > 0 AND doc_id IS NOT NULL")
    grouped = sets.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    classes = scratch.table(grouped.select("set_a", "set_b", "n", F.col("first.doc_id").alias("rep"), "first.mark").withColumn("node", F.monotonically_increasing_id()), "classes")
    own = signed.where("n > 0 AND doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep").join(classes, ["set_a", "set_b", "n", "rep", "mark"])
    members = own.select("node", "n", F.explode("bands").alias("key"))
    hubs = scratch.table(members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).where("hub.node <> last").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    shared = scratch.table(join_by_size(members, hubs, ["key"]).select("key", "hub", "hub_n", "node", "n"), "buckets")
    scratch.drop("signed", "hubs")
    near = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * threshold
    first = shared.where("node <> hub").where(near).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.table(confirm(first, classes, docs, scratch, threshold), "links")
    # texts of one id belong together, whatever they are
    sized = F.struct("set_a", "set_b", "n")
    several = scratch.table(sets.groupBy("doc_id").agg(F.min(sized).alias("low"), F.max(sized).alias("high")).where("low <> high").select("doc_id"), "several")
    own = join_by_size(sets.select("doc_id", "set_a", "set_b", "n"), several, ["doc_id"], "left_semi").join(classes.select("set_a", "set_b", "n", "node"), ["set_a", "set_b", "n"])
    own = scratch.table(own.select("doc_id", F.col("node").alias("b")).distinct(), "same-id")
    same = join_by_size(own, scratch.table(own.groupBy("doc_id").agg(F.min("b").alias("a")), "same-first"), ["doc_id"]).where("a <> b").select("a", "b")
    links = links.unionByName(same)
    groups = components(links)

    at = scratch.table(shared.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    split = scratch.table(at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"), "split")
    # the hub is held against all its bucket already
    rest = join_by_size(at.where("node <> hub"), split, ["key"], "left_semi").select("node", "n", "component")
    few = classes.where(F.col("n") < SMALL).select("node", "n").join(groups, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    rest = scratch.table(rest.unionByName(few).distinct(), "rest")
    meet, rare = prefix_cells(rest, classes, docs, scratch, threshold)
    for pairs in (_pairs, lambda meet: cell_pairs(meet, rare, groups)):  # one pair of two cells may join them; only then all
        more = scratch.table(confirm(pairs(meet), classes, docs, scratch, threshold), "more-links")
        if more.limit(1).count():
            links = links.unionByName(more)
            groups = components(links)

    placed = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.table(placed.join(least, "component").select("set_a", "set_b", F.col("n").alias("size"), "component_id"), "named")
    scratch.drop("ids", "first", "texts", "pairs", "counts", "classes", "buckets", "links", "several", "same-id", "same-first", "placed", "split", "rest", "rare", "tokens", "cells", "meet", "more-links")
    out = slim.join(named, (slim["set_a"] == named["set_a"]) & (slim["set_b"] == named["set_b"]) & (slim["n"] == named["size"]) & slim["doc_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "mark")
