"""Metric blocks and prompt texts for an optional language model; the model itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import model as M

#: Names that are counted in expressions, by plain containment.
TOKENS = ("CALCULATE", "FILTER", "ALL", "RELATED", "SUMX", "VAR", "IF", "AND", "OR", "DIVIDE", "SWITCH", "SAMEPERIODLASTYEAR")


def token_usage(measures: DataFrame, top: int = 8) -> DataFrame:
    """project, token, n: in how many expressions each token occurs, the most used first."""
    tokens = F.explode(F.array(*map(F.lit, TOKENS)))
    rows = measures.select("project", F.upper(F.coalesce("expression", F.lit(""))).alias("e"), tokens.alias("token")).where(F.contains("e", "token"))
    n = rows.groupBy("project", "token").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "token"))).where(F.col("rank") <= top)


def metrics(r: Mapping[str, DataFrame]) -> DataFrame:
    """project, block, name, value: the numbers of the overview, expression, performance and quality blocks."""
    live = r["measures"].where("NOT is_stub").groupBy("project").agg(F.bround(F.avg("complexity_score"), 2).alias("mean_complexity"), F.max("complexity_score").alias("max_complexity"))
    text = F.coalesce("expression", F.lit(""))
    patterns = r["measures"].groupBy("project").agg(
        F.count_if(F.size("dependencies") > 0).alias("with_dependencies"), F.count_if(F.contains(text, F.lit("VAR "))).alias("uses_var"), F.count_if(F.contains(text, F.lit("CALCULATE("))).alias("uses_calculate")
    )
    hubs = M.degrees(r["relationships"], True).groupBy("project").agg(F.max("degree").alias("largest_hub"))
    edges = r["relationships"].groupBy("project").agg(
        F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"),
        F.count_if(F.col("is_active") & (F.col("from_cardinality") == "many") & (F.col("to_cardinality") == "many")).alias("many_to_many"),
        F.count_if(F.col("is_active") & (F.col("cross_filter_direction") == "Both")).alias("bidirectional"),
    )
    alone = M.isolated(r["tables"], r["relationships"]).groupBy("project").agg(F.count("*").alias("isolated_tables"))
    waste = r["column_usage"].groupBy("project").agg(F.count_if(F.col("unused_columns") > 0).alias("tables_with_unused"))
    pages = r["pages"].groupBy("project").agg(F.count("*").alias("pages"), F.sum("visuals_count").alias("visuals"))
    wide = r["tables"].select("project").distinct()
    for part in (r["unused_summary"], live, patterns, r["schema"], r["usage_summary"], hubs, edges, alone, waste, pages):
        wide = wide.join(part, "project", "left")
    wide = wide.na.fill(0, ["total_measures", "used_measures", "unused_measures", *patterns.columns[1:], *edges.columns[1:], "isolated_tables", "tables_with_unused", "pages", "visuals"])
    blocks = {
        "overview": ("n_tables", "n_edges", "active", "n_facts", "total_columns", "total_unused", "tables_with_unused", "pages", "visuals", "total_measures", "unused_measures", "mean_complexity", "max_complexity"),
        "expressions": ("total_measures", "used_measures", "unused_measures", "with_dependencies", "uses_var", "uses_calculate", "mean_complexity", "max_complexity"),
        "performance": ("largest_hub", "inactive", "many_to_many", "bidirectional", "isolated_tables", "total_columns", "total_unused"),
        "quality": ("total_columns", "used_columns", "total_unused", "tables_with_unused", "average_table_usage_percentage"),
    }
    pairs = [F.struct(F.lit(b).alias("block"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for b, names in blocks.items() for n in names]
    return wide.select("project", F.explode(F.array(*pairs)).alias("m")).select("project", "m.*")


def _listed(rows: DataFrame, block: str, number: int, title: str, line: Column, order: list, limit: int | None = None) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(*order)))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("project", F.lit(block).alias("block"), F.lit(number).alias("list_no"), F.lit(title).alias("title"), "rank", F.concat(F.lit("- "), line).alias("line"))


def lists(r: Mapping[str, DataFrame]) -> DataFrame:
    """project, block, list_no, title, rank, line: the tables and measures that a block names. Ties by name."""
    table, measure = [F.col("table")], [F.desc("complexity_score"), F.col("name"), F.col("table")]
    classes = r["classifications"].groupBy("project", "classification").agg(F.count("*").alias("n"))
    types = r["columns"].groupBy("project", F.coalesce("data_type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    start = F.btrim(F.regexp_replace(F.left(F.coalesce("expression", F.lit("")), F.lit(100)), r"\s+", " "))
    waste = F.bround(F.col("unused_columns") * 100.0 / F.greatest("total_columns", F.lit(1)), 1)
    parts = [
        _listed(classes, "overview", 1, "Tables by class", F.format_string("%s: %d", "classification", "n"), [F.desc("n"), F.col("classification")]),
        _listed(types, "overview", 2, "Columns by type", F.format_string("%s: %d", "type", "n"), [F.desc("n"), F.col("type")]),
        _listed(token_usage(r["measures"]).drop("rank"), "expressions", 1, "Most used functions", F.format_string("%s: %d", "token", "n"), [F.desc("n"), F.col("token")]),
        _listed(r["measures"].where("NOT is_stub"), "expressions", 2, "Most complex measures", F.concat(F.col("name"), F.lit(" (complexity "), F.col("complexity_score").cast("string"), F.lit("): "), start), measure, 5),
        _listed(r["unused_measures"], "expressions", 3, "Unused measures", F.concat(F.col("name"), F.lit(" ("), F.col("table"), F.lit("): complexity "), F.col("complexity_score").cast("string")), measure, 10),
        _listed(M.degrees(r["relationships"], True), "performance", 1, "Hub tables", F.format_string("%s: %d relationships", "table", "degree"), [F.desc("degree"), *table], 5),
        _listed(r["tables"], "performance", 2, "Widest tables", F.format_string("%s: %d columns", "table", "column_count"), [F.desc("column_count"), *table], 5),
        _listed(r["column_usage"], "performance", 3, "Tables with most unused columns", F.format_string("%s: %d unused columns", "table", "unused_columns"), [F.desc("unused_columns"), *table], 5),
        _listed(r["column_usage"], "quality", 1, "Tables with most column waste", F.concat(F.format_string("%s: %d of %d columns unused (", "table", "unused_columns", "total_columns"), waste.cast("string"), F.lit(" %)")), [F.desc("unused_columns"), *table], 5),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def prompts(r: Mapping[str, DataFrame]) -> DataFrame:
    """project, block, prompt: one text for each metric block, its numbers first, then its lists."""
    lines = metrics(r).withColumn("line", F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("unknown"))))
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    heads = lines.groupBy("project", "block").agg(F.concat(F.lit("Describe this model's "), F.first("block"), F.lit(" from its metrics:\n"), text).alias("head"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    each = lists(r).groupBy("project", "block", "list_no", "title").agg(F.concat(F.lit("\n\n"), F.col("title"), F.lit(":\n"), F.array_join(ranked, "\n")).alias("text"))
    whole = each.groupBy("project", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list_no", "text"))), lambda x: x["text"]), "").alias("listed"))
    return heads.join(whole, ["project", "block"], "left").select("project", "block", F.concat("head", F.coalesce("listed", F.lit(""))).alias("prompt"))


def complete(prompts_: DataFrame, client: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """project, block, answer: ``client`` called for each prompt on the executors; a prompt that keeps failing gets the error as its answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            answers = []
            for prompt in batch.column("prompt").to_pylist():
                for k in range(attempts):
                    try:
                        answers.append(client(prompt))
                        break
                    except Exception as e:  # noqa: BLE001  any failure of the caller's client is reported in its row
                        if k == attempts - 1:
                            answers.append(f"failed: {e}")
                        else:
                            time.sleep(2 ** (k + 1))
            yield pa.RecordBatch.from_arrays([batch.column("project"), batch.column("block"), pa.array(answers, pa.string())], names=["project", "block", "answer"])

    return prompts_.select("project", "block", "prompt").mapInArrow(run, "project string, block string, answer string")

