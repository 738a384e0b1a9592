"""Mixing sources to target weights by hash-threshold histograms.

Sources, ordered by code point with null last, weigh 1, 2, 3, repeating. A
source may be repeated up to ``MAX_REPEAT`` times; what its weight would give it
beyond that goes to the others by weight. A source's target is met by whole
passes over it plus the documents whose hash lies below a threshold. The
threshold is found without sorting: sizes are summed by source and hash bucket,
and only the bucket in which the budget runs out is summed again by finer
buckets, until one hash value is left. A document at the boundary is taken if
that brings the total nearer to the target. Histograms and what is known of each
source stay in tables: nothing but row counts reaches the driver, and the plan is
broadcast only while it is small, so sources may be many.

Nulls: a null text has size 0; a null source is a source; a null ``doc_id`` is
hashed as an empty text. Rows that share a ``doc_id`` share a hash and are taken
or left together. Sources without words get target 0. An empty table gives an
empty result. Extra columns of the input are ignored (or kept, in ``mix``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_by_size

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Bits of the hash that each level of the histogram resolves.
LEVEL_BITS = 12
HASH_BITS = 60


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: str) -> Column:
    """60 bits of the md5 of the id as text."""
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, size) with no (its number, from 0) and target: min(repeat * size, level * weight), where all targets sum to all sizes.

    The level is the largest of what the sources that are not full yet would
    get a unit of weight, with ever more of the smallest full ones left out.
    Sources are numbered and summed up in order: a row a source, in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sizes.withColumn("no", (F.row_number().over(order) - 1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("long")
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("size") * repeat)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("size").over(every) - F.coalesce(F.sum("cap").over(fill), F.lit(0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    rows = rows.withColumn("level", F.greatest(left / open_, F.lit(0.0)))
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))
    return rows.select("no", "source", "size", "target")


def plan(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """For each source: source, source_size, target, whole passes and the hash threshold (exclusive) of one more pass.

    ``sized`` has source, size and hash. Each level sums the sizes of a source's
    current bucket by at most two to the power LEVEL_BITS finer ones, and steps
    to the one in which its budget ends.
    """
    sizes = scratch.table(targets(scratch.table(sized.groupBy("source").agg(F.sum("size").alias("size")), "sizes"), weights, repeat), "targets")
    passes = F.when(F.col("size") > 0, F.least(F.lit(repeat), F.floor(F.col("target") / F.greatest("size", F.lit(1))))).otherwise(0).cast("int")
    state = sizes.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("size"))
    state = state.select("*", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("top"), F.when(F.col("rest") <= 0, F.lit(0).cast("long")).alias("threshold"))
    state = scratch.table(state, "state")
    rows = join_by_size(sized, sizes.select("source", F.col("no")), ["source"], null_safe=True).select("no", "size", "hash")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        state = scratch.table(_refined(rows, state, shift), "state")
    return state.select("source", F.col("size").alias("source_size"), "target", "passes", F.coalesce("threshold", F.lit(1 << HASH_BITS)).alias("threshold"))


def _refined(rows: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """One level: every open source's bucket cut into finer ones; its budget ends in the first whose running sum exceeds it."""
    open_ = state.where("threshold IS NULL").select("no", "top", "rest", "before")
    top = F.shiftrightunsigned("hash", shift + LEVEL_BITS)
    here = join_by_size(rows.withColumn("top", top), open_.select("no", "top"), ["no", "top"], "left_semi")
    sums = here.groupBy("no", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
    order = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("n").over(order)).join(open_, "no")
    ends = run.where(F.col("before") + F.col("run") > F.col("rest")).groupBy("no").agg(F.min(F.struct("bucket", "n", "run")).alias("end"))
    bucket, start = F.col("end.bucket"), F.col("before") + F.col("end.run") - F.col("end.n")
    last = F.when(start + F.col("end.n") / 2 < F.col("rest"), bucket + 1).otherwise(bucket)
    moved = state.join(ends, "no", "left")
    # a source whose buckets all fit is taken whole
    threshold = F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("end").isNull(), F.lit(1 << HASH_BITS))
    threshold = threshold.when(F.lit(shift == 0), last)
    return moved.select("no", "source", "size", "target", "passes", "rest", F.coalesce(start, "before").alias("before"), F.coalesce(bucket, "top").alias("top"), threshold.alias("threshold"))


def _measured(docs: DataFrame, weights: tuple[int, ...], repeat: int, size: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size("text").alias("size"), doc_hash("doc_id").alias("hash")), "sized")
    return sized, scratch.table(plan(sized, scratch, weights, repeat), "plan")


def _with_plan(df: DataFrame, by_source: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df``, whose columns may have any names, with those of the plan and copies, found by the given names."""
    mark = uuid.uuid4().hex
    named = by_source.select(*(F.col(c).alias(f"{c}-{mark}") for c in by_source.columns))
    keyed = df.withColumn(f"source-{mark}", F.col("source").cast("string"))
    out = join_by_size(keyed, named, [f"source-{mark}"], null_safe=True).drop(keyed[f"source-{mark}"])
    own = {c: F.col(f"`{c}-{mark}`") for c in by_source.columns}
    out = out.withColumn(f"copies-{mark}", own["passes"] + (doc_hash("doc_id") < own["threshold"]).cast("int"))
    return out, own | {"copies": F.col(f"`copies-{mark}`")}


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT, size: Callable[[str], Column] = word_count) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies and taken (copies * size)."""
    out, own = _with_plan(*_measured(docs, weights, repeat, size))
    return out.select("doc_id", F.col("source"), "size", *(own[c].alias(c) for c in ("source_size", "target", "copies")), (own["copies"] * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT, size: Callable[[str], Column] = word_count) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    _, by_source = _measured(docs, weights, repeat, size)
    out, own = _with_plan(docs, by_source)
    copies = out.where(own["copies"] > 0).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), own["copies"])).alias(f"copy-{uuid.uuid4().hex}"))
    return copies.select(*(F.col(f"`{c}`") for c in docs.columns))
