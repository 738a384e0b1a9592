"""The data of charts; ``svg`` draws them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import model as M


def relationship_graph(tables: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (size 100 a column, kind by name) and distinct edges between known tables; of parallel ones the last id stays."""
    low = F.lower("table")
    colour = K.first_of([(low.contains("fact"), "fact"), (low.contains("dim"), "dimension"), (low.contains("bridge"), "bridge"), (low.contains("measure"), "measure")], "other")
    nodes = tables.select("project", "table", (F.col("column_count") * 100).alias("size"), colour.alias("kind"))
    known = tables.select("project", "table")
    kept = edges.join(known.withColumnRenamed("table", "from_table"), ["project", "from_table"], "left_semi").join(known.withColumnRenamed("table", "to_table"), ["project", "to_table"], "left_semi")
    return nodes, kept.groupBy("project", "from_table", "to_table").agg(F.max_by("cardinality", "id").alias("cardinality"), F.count("*").alias("n"))


def measure_graph(measures: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (size 150 a point of complexity, three levels) and edges without loops."""
    level = F.when(F.col("complexity_score") <= 3, "low").when(F.col("complexity_score") <= 6, "medium").otherwise("high")
    return measures.select("project", "name", (F.col("complexity_score") * 150).alias("size"), level.alias("level")), edges.where("name <> dependency")


def measure_graph_statistics(measures: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = measures.groupBy("project").agg(F.count("*").alias("nodes"), F.bround(F.avg("complexity_score"), 2).alias("average_complexity"))
    return nodes.join(edges.where("name <> dependency").groupBy("project").agg(F.count("*").alias("edges"), F.countDistinct("dependency").alias("used_measures")), "project", "left").na.fill(0)


def heatmap(tables: DataFrame, edges: DataFrame, measures: DataFrame | None = None, top: int = 15) -> DataFrame:
    """project, table, column, measure and relationship metrics (at most 10 each), average complexity; the ``top`` rows by their sum."""
    rows = tables.join(M.degrees(edges), ["project", "table"], "left").na.fill(0, ["degree"])
    if measures is not None:
        rows = rows.join(measures.groupBy("project", "table").agg(F.avg("complexity_score").alias("complexity")), ["project", "table"], "left").na.fill(0.0, ["complexity"])
    else:
        rows = rows.withColumn("complexity", F.lit(0.0))
    cap = lambda c: F.least(c.cast("double"), F.lit(10.0))
    rows = rows.select("project", "table", cap(F.col("column_count") / 5).alias("column_metric"), cap(F.col("measure_count") * 2).alias("measure_metric"), cap(F.col("degree") * 2).alias("relationship_metric"), "complexity")
    rows = rows.withColumn("total", F.col("column_metric") + F.col("measure_metric") + F.col("relationship_metric") + F.col("complexity"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("total"), "table"))).where(F.col("rank") <= top)


def class_shares(classes: DataFrame) -> DataFrame:
    """project, classification, n, share in percent; classes without tables are left out."""
    n = classes.groupBy("project", "classification").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("project")), 1))


def datatype_bars(columns: DataFrame) -> DataFrame:
    """project, display_type, n."""
    return columns.groupBy("project", K.display_type(F.col("name"), F.col("data_type")).alias("display_type")).agg(F.count("*").alias("n"))


def datatype_statistics(columns: DataFrame) -> DataFrame:
    """project, columns in all, distinct display types and the most frequent one (ties by name)."""
    bars = datatype_bars(columns).groupBy("project").agg(F.sum("n").cast("long").alias("total"), F.count("*").alias("distinct_types"), F.min(F.struct((-F.col("n")).alias("n"), "display_type"))["display_type"].alias("most_common"))
    return bars
