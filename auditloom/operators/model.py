"""Table profiles, classes, schema type and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as S
from ..sources.shared import ensure_checkpoint_dir


def endpoints(edges: DataFrame) -> DataFrame:
    """project, table: both ends of every edge."""
    return edges.select("project", F.explode(F.array("from_table", "to_table")).alias("table"))


def profile(columns: DataFrame, edges: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """A row for each table: counts by type, degrees, ratios. ``tables`` gives names, measures and datatable flags; else the columns' tables."""
    key = ["project", "table"]
    kind = F.col("data_type")
    concat = F.col("is_calculated") & F.coalesce(F.col("expression").rlike(r"&|(?i)\bCONCATENATE"), F.lit(False)) if "expression" in columns.columns else F.lit(False)
    counts = columns.withColumn("is_concatenated", concat).groupBy(*key).agg(
        F.count("*").alias("columns"),
        F.count_if(kind.isin("int64", "double", "decimal", "currency", "int32")).alias("numeric_columns"),
        F.count_if(kind == "string").alias("string_columns"),
        F.count_if(kind.isin("dateTime", "date")).alias("date_columns"),
        F.count_if(kind == "boolean").alias("boolean_columns"),
        F.count_if("is_calculated").alias("calculated_columns"),
        F.count_if("is_concatenated").alias("concatenated_columns"),
        F.count_if(F.col("is_concatenated") & (kind == "string") & K.is_key(F.col("name"))).alias("text_concatenated_keys"),
        F.count_if(kind.isin("int64", "double", "decimal", "currency", "int32") & (F.lower(F.coalesce("summarize_by", F.lit("none"))) != "none")).alias("summarized_columns"),
    )
    out_degree = edges.groupBy("project", F.col("from_table").alias("table")).agg(
        F.count("*").alias("relationships_from"),
        F.count_if("is_active").alias("active_from"),
        F.count_if(F.col("is_active") & (F.col("from_cardinality") != "many")).alias("active_from_one"),
    )
    in_degree = edges.groupBy("project", F.col("to_table").alias("table")).agg(F.count("*").alias("relationships_to"))
    base = counts if tables is None else tables.select(*key, F.col("measure_count").alias("measures"), "has_datatable").join(counts, key, "left")
    if tables is None:
        base = base.withColumn("measures", F.lit(0).cast("long")).withColumn("has_datatable", F.lit(False))
    out = base.where(~K.is_internal_table(F.col("table"))).join(out_degree, key, "left").join(in_degree, key, "left").na.fill(0)
    out = out.withColumn("total_relationships", F.col("relationships_from") + F.col("relationships_to")).withColumn("is_isolated", F.col("total_relationships") == 0)
    ratio = lambda c: F.coalesce(F.bround(F.try_divide(F.col(c).cast("double"), F.col("columns").cast("double")), 4), F.lit(0.0))
    for name in ("numeric", "string", "date", "calculated"):
        out = out.withColumn(f"{name}_ratio", ratio(f"{name}_columns"))
    return out.withColumn("name_tokens", S.name_tokens(F.col("table")))


def _points(when: Column, points: int) -> Column:
    return F.when(when, points).otherwise(0)


def class_scores(p: DataFrame) -> DataFrame:
    """``p`` with the five counters and what speaks for a fact; all rules that apply add up."""
    named = {cls: _points(F.arrays_overlap("name_tokens", F.array(*map(F.lit, words))), points) for cls, (words, points) in K.NAME_WORDS.items()}
    c = F.col
    out, into, text_keys = c("relationships_from"), c("relationships_to"), c("text_concatenated_keys")
    many = (c("active_from") >= 4) & (c("active_from_one") == 0)
    alone = (into == 0) & (out >= 3)
    summed = c("summarized_columns") >= 3
    fact = named["FACT"] + _points((c("numeric_columns") >= 2) & (out >= 2), 25) + _points(out >= 3, 20) + _points((c("calculated_columns") >= 3) & (out >= 2), -15)
    fact = fact + _points(text_keys > 0, -10) + _points((out >= 2) & (c("calculated_columns") == 0) & (text_keys == 0), 10) + _points(many, 50) + _points(alone, 45) + _points(summed, 40)
    dimension = named["DIMENSION"] + _points((into >= 2) & (out == 0), 25) + _points(c("date_columns") >= 2, 25) + _points(text_keys > 0, -8)
    calculation = named["CALCULATION"] + _points((c("measures") >= 10) & (c("columns") <= 2), 50) + _points((c("measures") >= 5) & (c("columns") <= 1), 35)
    parameter = named["PARAMETER"] + _points(c("has_datatable") & (c("columns") <= 5), 25) + _points((c("columns") <= 3) & c("is_isolated"), 20)
    evidence = F.filter(
        F.array(
            F.when(many, F.format_string("%d many-side relationships", "active_from")),
            F.when(alone, F.format_string("no incoming, %d outgoing relationships", "relationships_from")),
            F.when(summed, F.format_string("%d summarised numeric columns", "summarized_columns")),
        ),
        lambda x: x.isNotNull(),
    )
    scored = p.select("*", fact.alias("FACT"), dimension.alias("dimension_0"), named["BRIDGE"].alias("BRIDGE"), calculation.alias("CALCULATION"), parameter.alias("PARAMETER"), evidence.alias("evidence"))
    most = F.greatest("FACT", "dimension_0", "BRIDGE", "CALCULATION", "PARAMETER")
    return scored.withColumn("DIMENSION", F.when(most == 0, 10).otherwise(F.col("dimension_0"))).drop("dimension_0")


def classify(p: DataFrame) -> DataFrame:
    """project, table, classification, confidence, reasoning, scores and the profile; ties go in the order of the classes."""
    scored = class_scores(p)
    best = F.greatest(*K.CLASSES)
    label = K.first_of([(F.col(name) == best, name) for name in K.CLASSES[:-1]], K.CLASSES[-1])
    total = sum((F.col(name) for name in K.CLASSES[1:]), F.col(K.CLASSES[0]))
    reasoning = F.when((F.col("classification") == "FACT") & (F.size("evidence") > 0), F.array_join("evidence", "; ")).otherwise("N/A")
    return scored.withColumn("classification", label).withColumn("confidence", K.confidence(best, total)).withColumn("reasoning", reasoning)


def edge_classes(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges with the classes of both ends (null if the table is unknown)."""
    named = classes.select("project", "table", "classification")
    start = named.withColumnsRenamed({"table": "from_table", "classification": "from_class"})
    end = named.withColumnsRenamed({"table": "to_table", "classification": "to_class"})
    return edges.join(start, ["project", "from_table"], "left").join(end, ["project", "to_table"], "left")


def schema_type(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, counts and schema_type, in the fixed order of decisions."""
    counts = classes.groupBy("project").agg(F.count("*").alias("n_tables"), F.count_if(F.col("classification") == "FACT").alias("n_facts"), F.count_if(F.col("classification") == "DIMENSION").alias("n_dimensions"))
    both = lambda a, b: (F.col("from_class") == a) & (F.col("to_class") == b)
    links = edge_classes(edges, classes).groupBy("project").agg(
        F.count("*").alias("n_edges"),
        F.count_if(both("FACT", "DIMENSION") | both("DIMENSION", "FACT")).alias("fact_dimension"),
        F.count_if(both("DIMENSION", "DIMENSION")).alias("dimension_dimension"),
    )
    t = counts.join(links, "project", "left").na.fill(0)
    c = F.col
    kind = K.first_of(
        [
            (c("n_tables") == 0, "UNKNOWN"),
            ((c("n_edges") == 0) & (c("n_tables") <= 2), "FLAT"),
            (c("n_edges") == 0, "DISCONNECTED"),
            ((c("n_facts") >= 2) & (c("fact_dimension") >= c("n_facts")), "GALAXY"),
            ((c("dimension_dimension") > 0) & (c("n_facts") >= 1), "SNOWFLAKE"),
            ((c("n_facts") == 1) & (c("fact_dimension") >= 2), "STAR"),
            (c("n_facts") == 0, "DIMENSIONAL"),
        ],
        "UNKNOWN",
    )
    return t.withColumn("schema_type", kind)


def components(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """project, table, component (its smallest table); edges to unknown tables do not connect. Each round is checkpointed."""
    ensure_checkpoint_dir(tables.sparkSession)
    now = tables.select("project", "table").distinct().withColumn("component", F.col("table"))
    pairs = edges.select("project", F.col("from_table").alias("a"), F.col("to_table").alias("b"))
    known = tables.select("project", F.col("table").alias("a")).distinct()
    pairs = pairs.unionByName(pairs.select("project", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = pairs.join(known, ["project", "a"], "left_semi").join(known.withColumnRenamed("a", "b"), ["project", "b"], "left_semi")
    before = None
    while True:
        # labels step to the smallest neighbour's, then to that label's own: paths halve
        near = pairs.join(now.withColumnRenamed("table", "b"), ["project", "b"]).groupBy("project", F.col("a").alias("table")).agg(F.min("component").alias("near"))
        step = now.join(near, ["project", "table"], "left").select("project", "table", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select("project", F.col("table").alias("component"), F.col("component").alias("further"))
        now = step.join(jump, ["project", "component"], "left").select("project", "table", F.least("component", F.coalesce("further", "component")).alias("component")).checkpoint()
        mark = now.agg(F.sum(F.xxhash64("project", "table", "component").cast("decimal(20,0)"))).first()[0]
        if mark == before:
            return now
        before = mark


def isolated(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables that no edge touches."""
    return tables.select("project", "table").distinct().join(endpoints(edges).distinct(), ["project", "table"], "left_anti")


def shared_dimensions(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """project, dimension, n_edges: dimensions that two edges or more tie to facts."""
    e = edge_classes(edges, classes)
    forward = (F.col("from_class") == "FACT") & (F.col("to_class") == "DIMENSION")
    backward = (F.col("to_class") == "FACT") & (F.col("from_class") == "DIMENSION")
    return e.where(forward | backward).groupBy("project", F.when(forward, F.col("to_table")).otherwise(F.col("from_table")).alias("dimension")).agg(F.count("*").alias("n_edges")).where("n_edges >= 2")


def degrees(edges: DataFrame, active_only: bool = False) -> DataFrame:
    rows = edges.where("is_active") if active_only else edges
    return endpoints(rows).groupBy("project", "table").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, top: int = 5) -> DataFrame:
    """project, table, degree, rank: the ``top`` tables of each project that most active relationships touch, ties by name."""
    order = Window.partitionBy("project").orderBy(F.desc("degree"), "table")
    return degrees(edges, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def class_counts(classes: DataFrame) -> DataFrame:
    """project and a count for each class, unknown included, with totals."""
    counts = [F.count_if(F.col("classification") == name).alias(f"{name.lower()}_tables") for name in K.CLASSES]
    return classes.groupBy("project").agg(
        F.count("*").alias("total_tables"), F.sum("columns").alias("total_columns"), F.sum("measures").alias("total_measures"), F.bround(F.avg("columns"), 2).alias("avg_columns_per_table"),
        S.mean(F.col("confidence")).alias("average_confidence"), *counts, F.count_if(~F.col("classification").isin(*K.CLASSES)).alias("unknown_tables"),
    )


def relationship_summary(classes: DataFrame, edges: DataFrame) -> DataFrame:
    base = classes.groupBy("project").agg(F.count("*").alias("total_tables"), F.bround(F.coalesce(S.mean(F.col("confidence")), F.lit(0.5)), 3).alias("average_classification_confidence"))
    links = edges.groupBy("project").agg(F.count("*").alias("total_relationships"), F.count_if("is_active").alias("active_relationships"), F.count_if(~F.col("is_active")).alias("inactive_relationships"))
    parts = components(classes, edges).groupBy("project", "component").agg(F.array_sort(F.collect_list("table")).alias("members")).groupBy("project").agg(F.count("*").alias("components"), F.sort_array(F.collect_list("members")).alias("component_details"))
    alone = isolated(classes, edges).groupBy("project").agg(F.array_sort(F.collect_list("table")).alias("isolated_tables"))
    return base.join(links, "project", "left").join(parts, "project", "left").join(alone, "project", "left").join(schema_type(classes, edges).select("project", "schema_type"), "project", "left").na.fill(0)
