"""Connected components of an edge table, by stars that grow and shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_by_size


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node.

    Each round joins every node's larger neighbours to its smallest one, then its
    smaller ones; hubs are summed map-side and no group is collected. Rounds grow
    with the logarithm of the longest chain. Each round is written, so a lost
    executor costs one round's tasks at most. Two numbers a round reach the driver.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    mark = print_of(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written tables: joins with them can be split at a hub
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = scratch.table(join_by_size(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = join_by_size(large, small_least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if (then := print_of(now)) == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
