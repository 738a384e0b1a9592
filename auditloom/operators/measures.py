"""The measure graph: resolved dependencies, depth, dependents, roles, unused measures and column usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import dax
from ..sources.shared import Run
from . import rings

#: Edges of a project, or of a ring, that one task takes: 216,000 take 300 MB of Python. Rounds over all tasks cost many times as much.
GROUP = 400_000


def dependencies(measures: DataFrame, columns: DataFrame) -> DataFrame:
    """project, name, dependency: bracketed names that are measures (self left out). A name that only columns have is no measure."""
    names = measures.select("project", F.col("name").alias("dependency")).distinct()
    raw = measures.select("project", "name", F.explode("candidates").alias("dependency")).distinct()
    return raw.join(names, ["project", "dependency"], "left_semi").join(columns.select("project", F.col("name").alias("dependency")).distinct(), ["project", "dependency"], "left_anti").select("project", "name", "dependency")


def depths(edges: DataFrame, group: int = GROUP) -> DataFrame:
    """project, name, depth: the longest path of dependencies (``rings.longest``); null where a ring is beyond an exact search.

    The edges of a project are one group up to ``group`` of them. A project with more is
    solved over all tasks: nodes whose dependencies are known are taken off in
    rounds, and a node with one dependency is skipped by those that depend on it, so
    a chain takes rounds with the logarithm of its length. What is left reaches a ring.
    Rings are found by colours that run along the edges and back; those that
    depend on known nodes only are solved as groups, and nodes are taken off again.
    """
    run = Run(edges.sparkSession, "depths")
    edges = run.settled(edges.select("project", "name", "dependency").distinct(), "edges")
    sizes = run.settled(edges.groupBy("project").agg(F.count("*").alias("n")), "sizes")
    small = _solved(edges.join(sizes.where(F.col("n") <= group).select("project"), "project", "left_semi"))
    large = edges.join(sizes.where(F.col("n") > group).select("project"), "project", "left_semi")
    if not sizes.where(F.col("n") > group).limit(1).count():
        return small
    return small.unionByName(_peeled(run.settled(large, "large"), run, group))


_NODE = ["project", "name"]
_DEPTHS = "project string, name string, depth int"


def _solved(edges: DataFrame, *keys: str) -> DataFrame:
    """``rings.longest`` of each project, or each group of ``keys``; a column ``known`` holds the depth of dependencies beyond the group (-1: none exists, null: not beyond)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict[str, set[str]] = {}
        given: dict[str, int | None] = {}
        for name, target, known in zip(pdf["name"], pdf["dependency"], pdf["known"], strict=True):
            own.setdefault(name, set()).add(target)
            if not pd.isna(known):
                given[target] = None if known < 0 else int(known)
        found = rings.longest(own, given)
        return pd.DataFrame({"project": pdf["project"].iloc[0], "name": list(found), "depth": pd.Series(list(found.values()), dtype="Int32")})

    rows = edges if "known" in edges.columns else edges.withColumn("known", F.lit(None).cast("int"))
    return rows.select("project", "name", "dependency", "known", *keys).groupBy("project", *keys).applyInPandas(run, _DEPTHS)


def _target(df: DataFrame, *more: str) -> DataFrame:
    return df.select("project", F.col("name").alias("dependency"), *more)


def _known(edges: DataFrame, done: DataFrame) -> DataFrame:
    """``edges`` with ``known``: the depth of dependencies that are done, -1 where they have none."""
    return edges.join(_target(done, F.coalesce("depth", F.lit(-1)).alias("known")), ["project", "dependency"], "left")


def _peeled(edges: DataFrame, run: Run, group: int) -> DataFrame:
    """Depths of all nodes that have edges, none of it in one task."""
    leaves = edges.select("project", F.col("dependency").alias("name")).distinct().join(edges.select(_NODE).distinct(), _NODE, "left_anti")
    done = run.settled(leaves.select(*_NODE, F.lit(0).alias("depth")), "done-0")
    number, left = 0, edges
    while True:
        done, left, number = _taken_off(left, done, run, number)
        if not left.limit(1).count():
            break
        left = run.settled(left, f"left-{number}")
        sizes = run.settled(left.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") <= group).select("project"), f"few-{number}")
        few = run.settled(_solved(_known(left.join(sizes, "project", "left_semi"), done)), f"solved-{number}")
        done, left = done.unionByName(few), run.settled(left.join(sizes, "project", "left_anti"), f"many-{number}")
        if not left.limit(1).count():
            break
        ring = run.settled(_ring_ids(left.join(done.select("project", F.col("name").alias("dependency")), ["project", "dependency"], "left_anti"), run, number), f"rings-{number}")
        both = _known(left, done).join(ring, _NODE).join(_target(ring, F.col("ring").alias("other")), ["project", "dependency"], "left")
        # a ring is ready when all its edges lead into it or to what is known
        waits = both.where(F.col("known").isNull() & ~F.col("ring").eqNullSafe(F.col("other"))).select("project", "ring").distinct()
        ready = run.settled(both.join(waits, ["project", "ring"], "left_anti"), f"ready-{number}")
        counts = ready.groupBy("project", "ring").agg(F.count("*").alias("n"))
        found = _solved(ready.join(counts.where(F.col("n") <= group), ["project", "ring"], "left_semi"), "ring")
        vast = ready.join(counts.where(F.col("n") > group), ["project", "ring"], "left_semi").select(*_NODE).distinct().withColumn("depth", F.lit(None).cast("int"))
        number += 1
        done = run.settled(done.unionByName(found).unionByName(vast), f"done-{number}")
        left = run.settled(left.join(done, _NODE, "left_anti"), f"left-{number}")
    return done.join(edges.select(_NODE).distinct(), _NODE, "left_semi")


def _taken_off(left: DataFrame, done: DataFrame, run: Run, number: int) -> tuple[DataFrame, DataFrame, int]:
    """Nodes all of whose dependencies are done are done, round by round; what is left reaches a ring.

    ``open`` holds edges that wait, with what lies between (cost), and ``base`` what a node has at least.
    """
    open_ = left.select(*_NODE, "dependency", F.lit(1).cast("long").alias("cost"))
    base = left.select(*_NODE).distinct().select(*_NODE, F.lit(0).cast("long").alias("base"), F.lit(False).alias("lost"))
    new = done
    while True:
        number += 1
        met = open_.join(_target(new, "depth", F.lit(True).alias("hit")), ["project", "dependency"], "left")
        met = run.settled(met, f"met-{number}")
        gained = met.where("hit").select(*_NODE, (F.col("cost") + F.coalesce("depth", F.lit(0))).alias("base"), F.col("depth").isNull().alias("lost"))
        base = base.unionByName(gained).groupBy(*_NODE).agg(F.max("base").alias("base"), F.max("lost").alias("lost"))
        base = run.settled(base, f"base-{number}")
        open_ = met.where("hit IS NULL").select(*_NODE, "dependency", "cost")
        ready = base.join(open_.select(*_NODE).distinct(), _NODE, "left_anti").select(*_NODE, F.when(~F.col("lost"), F.col("base")).cast("int").alias("depth"))
        new = run.settled(ready, f"new-{number}")
        if not new.limit(1).count():
            return done, left.join(done, _NODE, "left_anti"), number
        done = run.settled(done.unionByName(new), f"done-{number}")
        base = base.join(new, _NODE, "left_anti")
        # an edge to a node with one open dependency goes on to that one
        single = open_.groupBy(*_NODE).agg(F.count("*").alias("n"), F.min("dependency").alias("next"), F.min("cost").alias("more")).where("n = 1")
        single = single.join(base, _NODE).select("project", F.col("name").alias("dependency"), "next", "more", F.col("base").alias("floor"), F.col("lost").alias("gone"))
        jumped = run.settled(open_.join(single, ["project", "dependency"], "left"), f"jumped-{number}")
        floors = jumped.where("next IS NOT NULL").select(*_NODE, (F.col("cost") + F.col("floor")).alias("base"), F.col("gone").alias("lost"))
        base = base.unionByName(floors).groupBy(*_NODE).agg(F.max("base").alias("base"), F.max("lost").alias("lost"))
        cost = F.least(F.col("cost") + F.coalesce("more", F.lit(0)), F.lit(1 << 40))
        open_ = jumped.select(*_NODE, F.coalesce("next", "dependency").alias("dependency"), cost.alias("cost")).groupBy(*_NODE, "dependency").agg(F.max("cost").alias("cost"))


def _ring_ids(edges: DataFrame, run: Run, number: int) -> DataFrame:
    """project, name, ring of each node of ``edges``: the largest of the names that it reaches and is reached by.

    The largest name that reaches a node is its colour; a node from which the colour's own node can
    be reached without leaving the colour is in its ring. Those go, and the rest is coloured anew.
    """
    out, turn = None, 0
    while True:
        turn += 1
        nodes = edges.select(*_NODE).unionByName(edges.select("project", F.col("dependency").alias("name"))).distinct()
        colour = run.settled(nodes.withColumn("colour", F.col("name")), f"colour-{number}-{turn}-0")
        colour = _spread(edges.select("project", F.col("name").alias("source"), F.col("dependency").alias("name")), colour, run, f"colour-{number}-{turn}")
        inside = edges.join(colour, _NODE).join(_target(colour, F.col("colour").alias("other")), ["project", "dependency"]).where("colour = other")
        inside = run.settled(inside.select(*_NODE, "dependency", "colour"), f"inside-{number}-{turn}")
        found = colour.where("name = colour").withColumn("colour", F.col("name"))
        k = 0
        while True:  # back along the edges, from each colour's own node
            k += 1
            more = inside.join(_target(found, F.col("colour").alias("c")), ["project", "dependency"]).where("c = colour").select(*_NODE, "colour").distinct().join(found, _NODE, "left_anti")
            more = run.settled(more, f"back-{number}-{turn}-{k}")
            if not more.limit(1).count():
                break
            found = run.settled(found.unionByName(more), f"found-{number}-{turn}-{k}")
        rows = found.select(*_NODE, F.col("colour").alias("ring"))
        out = rows if out is None else out.unionByName(rows)
        rest = nodes.join(found, _NODE, "left_anti")
        if not rest.limit(1).count():
            return out
        edges_left = edges.join(rest, _NODE, "left_semi").join(_target(rest), ["project", "dependency"], "left_semi")
        alone = rest.join(edges_left.select(*_NODE).unionByName(edges_left.select("project", F.col("dependency").alias("name"))).distinct(), _NODE, "left_anti")
        out = out.unionByName(alone.select(*_NODE, F.col("name").alias("ring")))
        edges = run.settled(edges_left, f"rest-{number}-{turn}")
        if not edges.limit(1).count():
            return out


def _spread(ways: DataFrame, colour: DataFrame, run: Run, name: str) -> DataFrame:
    """The largest colour that reaches each node along ``ways`` (source to name)."""
    k = 0
    while True:
        k += 1
        sent = ways.join(colour.select("project", F.col("name").alias("source"), "colour"), ["project", "source"]).select(*_NODE, "colour")
        after = run.settled(colour.unionByName(sent).groupBy(*_NODE).agg(F.max("colour").alias("colour")), f"{name}-{k}")
        if not after.join(colour.withColumnRenamed("colour", "before"), _NODE).where("colour <> before").limit(1).count():
            return after
        colour = after


def graph(measures: DataFrame, edges: DataFrame) -> DataFrame:
    """``measures`` with dependencies, depth (null, and not ``depth_known``, behind a ring beyond an exact search), dependents, base and leaf flags, role and architectural complexity; keyed by name."""
    out_edges = edges.groupBy("project", "name").agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"))
    in_edges = edges.groupBy("project", F.col("dependency").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("dependents"))
    empty = F.array().cast("array<string>")
    rows = measures.join(out_edges, ["project", "name"], "left").join(in_edges, ["project", "name"], "left").join(depths(edges), ["project", "name"], "left")
    rows = rows.withColumn("dependencies", F.coalesce("dependencies", empty)).withColumn("dependents", F.coalesce("dependents", empty))
    rows = rows.withColumn("depth_known", (F.size("dependencies") == 0) | F.col("depth").isNotNull())
    rows = rows.withColumn("dependency_depth", F.when(F.col("depth_known"), F.coalesce("depth", F.lit(0)))).drop("depth").withColumn("dependents_count", F.size("dependents"))
    rows = rows.withColumn("is_base_measure", F.size("dependencies") == 0).withColumn("is_leaf_measure", F.col("dependents_count") == 0)
    rows = rows.withColumn("architectural_role", dax.role(F.col("is_base_measure"), F.col("dependents_count")))
    return rows.withColumn("architectural_complexity", F.bround(F.col("complexity_score") + F.col("dependents_count") * 0.3 + F.col("dependency_depth") * 0.2, 2))


def visual_fields(visuals: DataFrame) -> DataFrame:
    """project, name: what visuals show; the bracketed part if there is one."""
    field = F.explode("all_fields")
    rows = visuals.select("project", field.alias("f")).distinct()
    inner = F.regexp_extract("f", r"\[([^\]]+)\]", 1)
    return rows.select("project", F.when(inner != "", inner).otherwise(F.regexp_replace("f", r"^.*\.", "")).alias("name")).unionByName(rows.select("project", F.col("f").alias("name"))).distinct()


def unused(measures: DataFrame, edges: DataFrame, visuals: DataFrame | None = None) -> DataFrame:
    """Measures that no other measure and no visual uses, with the risk of deleting them."""
    used = edges.where("name <> dependency").select("project", F.col("dependency").alias("name"))
    if visuals is not None:
        used = used.unionByName(visual_fields(visuals))
    rows = measures.join(used.distinct(), ["project", "name"], "left_anti")
    risk = dax.cleanup_risk(F.col("is_stub"), F.col("complexity_score"), F.col("is_base_measure"))
    reason = K.first_of(
        [(F.col("cleanup_risk") == "SAFE_DELETE", "Stub or no logic"), (F.col("cleanup_risk") == "DO_NOT_DELETE", "Base measure: may be used elsewhere"), (F.col("cleanup_risk") == "INVESTIGATE", "Complex and unreferenced")],
        "Unreferenced: review",
    )
    return rows.withColumn("cleanup_risk", risk).withColumn("reason", reason)


def unused_summary(measures: DataFrame, unused_: DataFrame) -> DataFrame:
    """project, total, used, unused, percentage (one decimal) and counts by risk."""
    total = measures.groupBy("project").agg(F.countDistinct("name").alias("names"), F.count("*").alias("total_measures"))
    risks = [F.count_if(F.col("cleanup_risk") == r).alias(r.lower()) for r in ("SAFE_DELETE", "REVIEW_SUGGESTED", "INVESTIGATE", "DO_NOT_DELETE")]
    left = unused_.groupBy("project").agg(F.count("*").alias("unused_measures"), F.countDistinct("name").alias("unused_names"), *risks)
    out = total.join(left, "project", "left").na.fill(0)
    return out.withColumn("used_measures", F.col("names") - F.col("unused_names")).withColumn("unused_percentage", F.bround(F.try_divide(F.col("unused_measures") * 100.0, F.col("total_measures")), 1)).drop("names", "unused_names")


def column_hits(columns: DataFrame, measures: DataFrame, visuals: DataFrame | None = None) -> DataFrame:
    """project, table, name, hit of each column: used by name, in measures or visuals. Measure names do not count as columns."""
    used = measures.select("project", F.explode("bracketed").alias("name"))
    used = used.join(measures.select("project", "name").distinct(), ["project", "name"], "left_anti")
    if visuals is not None:
        used = used.unionByName(visual_fields(visuals))
    return columns.select("project", "table", "name").distinct().join(used.distinct().withColumn("hit", F.lit(True)), ["project", "name"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def unused_columns(hits: DataFrame) -> DataFrame:
    """project, table, name of the columns that nothing uses; a table without any is not there."""
    return hits.where("NOT hit").select("project", "table", "name")


def column_usage(columns: DataFrame, measures: DataFrame, visuals: DataFrame | None = None, names: bool = True) -> DataFrame:
    """A row for each table: how many columns are used, and the first of them; with ``names``, which: a table of a model has few, other groups may be too large for a list."""
    listed = [
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("name")))).alias("used_column_names"),
        F.array_sort(F.collect_set(F.when(~F.col("hit"), F.col("name")))).alias("unused_column_names"),
    ]
    out = column_hits(columns, measures, visuals).groupBy("project", "table").agg(
        F.count("*").alias("total_columns"),
        F.count_if("hit").alias("used_columns"),
        F.count_if(~F.col("hit")).alias("unused_columns"),
        F.min(F.when(F.col("hit"), F.col("name"))).alias("first_used"),
        *(listed if names else []),
    )
    return out.withColumn("usage_percentage", F.bround(F.col("used_columns") * 100.0 / F.col("total_columns"), 0).cast("int"))


def by_table(measures: DataFrame) -> DataFrame:
    """``measures`` with ``position``: the place among the measures of its table, by name and line."""
    return measures.withColumn("position", F.row_number().over(Window.partitionBy("project", "table").orderBy("name", "line")))


def usage_summary(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project").agg(
        F.sum("total_columns").alias("total_columns"),
        F.sum("used_columns").alias("used_columns"),
        F.sum("unused_columns").alias("total_unused"),
        F.count_if(F.col("usage_percentage") == 100).alias("tables_with_full_usage"),
        F.bround(F.avg("usage_percentage"), 1).alias("average_table_usage_percentage"),
    )


def lowest_usage(usage: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` tables of each project that are used least: by percentage, then most unused columns, then name."""
    order = Window.partitionBy("project").orderBy("usage_percentage", F.desc("unused_columns"), "table")
    return usage.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
