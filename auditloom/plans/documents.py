"""Documents as ordered lines: project, document, section_no, line_no, line. Rendering is a join of lines."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as S
from ..operators import measures, model, scoring
from . import svg


#: What the technical and the extended document read: ``prepare`` plans it at the same time.
RELATIONS = (
    "category_totals", "tables", "classifications", "unused_measures", "datasources", "relationships", "unused_summary", "pages", "usage_summary", "column_usage",
    "columns", "measures", "measure_edges", "schema", "score_metadata", "relationship_summary",
)


def _cells(*columns: str | Column) -> Column:
    cells = [S.markdown_cell(F.col(c) if isinstance(c, str) else c) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def section(rows: DataFrame, document: str, number: int, title: str, line: Column, order: list, header: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """A section's lines: title, table header if given, then one line for each row in order, at most ``limit`` a project."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy("project").orderBy(*order)))
    if limit is not None:
        numbered = numbered.where(F.col("__n") <= limit)
    body = numbered.select("project", (F.col("__n") + 10).alias("line_no"), line.alias("line"))
    heads = [f"## {title}", ""] + (["| " + " | ".join(header) + " |", "|" + "---|" * len(header)] if header else [])
    top = rows.select("project").distinct().select("project", F.posexplode(F.array(*map(F.lit, heads))).alias("line_no", "line"))
    return top.unionByName(body).select("project", F.lit(document).alias("document"), F.lit(number).alias("section_no"), F.col("line_no").cast("int").alias("line_no"), "line")


def _text(rows: DataFrame, document: str, number: int, *lines: Column | str) -> DataFrame:
    items = F.array(*(x if isinstance(x, Column) else F.lit(x) for x in lines))
    return rows.select("project", F.lit(document).alias("document"), F.lit(number).alias("section_no"), F.posexplode(items).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("int"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _values(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """project, no, label, value: the named columns of one row a project as rows."""
    items = F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for label, c in pairs))
    return rows.select("project", F.posexplode(items).alias("no", "item")).select("project", "no", "item.*")


def _risks(r: Mapping[str, DataFrame]) -> DataFrame:
    return _values(r["unused_summary"], ("Safe delete", "safe_delete"), ("Review suggested", "review_suggested"), ("Investigate", "investigate"), ("Do not delete", "do_not_delete"))


def _use(r: Mapping[str, DataFrame]) -> DataFrame:
    return _values(
        r["usage_summary"], ("Total columns", "total_columns"), ("Used columns", "used_columns"), ("Unused columns", "total_unused"),
        ("Average table usage %", "average_table_usage_percentage"), ("Tables with full usage", "tables_with_full_usage"),
    )


def _first(affected: Column, k: int = 3) -> Column:
    """The first ``k`` of sorted names and how many follow."""
    return F.concat(F.array_join(F.slice(affected, 1, k), ", "), F.when(F.size(affected) > k, F.format_string(" +%d more", F.size(affected) - k)).otherwise(""))


def technical(r: Mapping[str, DataFrame]) -> DataFrame:
    """The technical document: totals, sources, tables by class, composition, relationships, measures, cleanup risks, pages, usage."""
    d = "technical"
    place = F.coalesce(*(F.when(F.col(f"attributes.{c}") != "", F.col(f"attributes.{c}")) for c in ("server", "url", "path", "first_argument")), F.lit("-"))
    share = F.concat(F.bround(F.try_divide(F.col("value").cast("double") * 100, F.col("all")), 1).cast("string"), F.lit(" %"))
    kinds = _values(r["category_totals"], *((k.capitalize(), f"{k}_count") for k in ("chart", "table", "slicer", "button", "text", "card", "other", "hidden"))).join(r["category_totals"].select("project", F.col("visuals_count").alias("all")), "project")
    totals = r["tables"].groupBy("project").agg(F.count("*").alias("tables"), F.sum("column_count").alias("columns"), F.sum("measure_count").alias("measures"))
    named = r["tables"].join(r["classifications"].select("project", "table", "classification", "confidence"), ["project", "table"], "left")
    top = r["unused_measures"]
    return _all([
        _text(totals, d, 0, F.concat(F.lit("# Technical documentation: "), F.col("project")), F.format_string("%d tables, %d columns, %d measures", "tables", "columns", "measures")),
        section(r["datasources"], d, 1, "Data sources", _cells("type", "connector", place, F.coalesce("attributes.database", F.lit("-")), "confidence", "occurrences", F.size("references"), F.coalesce("privacy_note", F.lit(""))), [F.col("type"), F.col("connector"), F.col("id")], ("Type", "Connector", "Place", "Database", "Confidence", "Uses", "Files", "Note")),
        section(named, d, 2, "Tables by class", _cells("table", "classification", "column_count", "measure_count", "table_kind"), [F.col("classification"), F.col("table")], ("Table", "Class", "Columns", "Measures", "Kind")),
        section(r["relationships"], d, 3, "Relationships", _cells("from_table", "from_column", "to_table", "to_column", "cardinality", "is_active"), [F.col("from_table"), F.col("to_table"), F.col("id")], ("From", "Column", "To", "Column", "Cardinality", "Active")),
        section(r["unused_summary"], d, 4, "Measure use", F.format_string("%d of %d measures unused (%s %%)", "unused_measures", "total_measures", F.col("unused_percentage").cast("string")), [F.col("project")]),
        section(_risks(r), d, 5, "Cleanup risk", _cells("label", "value"), [F.col("no")], ("Risk", "Count")),
        section(top, d, 6, "Unused measures", _cells("name", "table", "complexity_score", "cleanup_risk", "reason"), [F.desc("complexity_score"), F.col("name"), F.col("table")], ("Measure", "Table", "Complexity", "Risk", "Reason"), 10),
        section(r["pages"], d, 7, "Pages", _cells("display_name", "visuals_count", "chart_count", "table_count", "card_count", "slicer_count"), [F.col("page_id")], ("Page", "Visuals", "Charts", "Tables", "Cards", "Slicers")),
        section(_use(r), d, 8, "Column use summary", F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("value")), [F.col("no")]),
        section(r["tables"], d, 10, "Composition", _cells("table", "column_count", "measure_count", "calculated_column_count", "hidden_column_count", "key_like_column_count", "partition_count"), [F.col("table")], ("Table", "Columns", "Measures", "Calculated", "Hidden", "Keys", "Partitions")),
        section(top, d, 11, "Most complex unused measures", F.concat(F.lit("- "), S.markdown_cell(F.col("name")), F.lit(" ("), F.col("table"), F.lit(")")), [F.desc("complexity_score"), F.col("name"), F.col("table")], limit=5),
        section(kinds, d, 12, "Visuals by category", _cells("label", "value", share), [F.col("no")], ("Category", "Visuals", "Share")),
        section(measures.lowest_usage(r["column_usage"]).drop("rank"), d, 13, "Least used tables", _cells("table", "usage_percentage", "unused_columns"), [F.col("usage_percentage"), F.desc("unused_columns"), F.col("table")], ("Table", "%", "Unused")),
        section(r["column_usage"], d, 9, "Column use", _cells("table", "total_columns", "used_columns", "usage_percentage"), [F.col("usage_percentage"), F.desc("unused_columns"), F.col("table")], ("Table", "Columns", "Used", "%")),
    ])


def extended(r: Mapping[str, DataFrame]) -> DataFrame:
    """The extended document: overview, tables, classes with reasons, measures, unused measures, columns, pages, column use, data quality, charts (beside it, where ``svg.drawings`` are written)."""
    d = "extended"
    summary = r["schema"]
    types = r["columns"].where("NOT is_calculated").groupBy("project", "table").agg(F.array_sort(F.collect_set("data_type")).alias("types"))
    more = F.when(F.size("dependencies") > 2, F.format_string(" +%d", F.size("dependencies") - 2)).otherwise("")
    counts = r["tables"].select("project", "table", "column_count", "measure_count", "table_kind").join(types, ["project", "table"], "left")
    usage = r["column_usage"].join(r["tables"].select("project", "table", "calculated_column_count", "measure_count", "table_kind"), ["project", "table"], "left")
    flags = r["relationships"].where(F.size("quality_flags") > 0)
    classes = model.class_counts(r["classifications"])
    sums = r["score_metadata"].join(r["usage_summary"].drop("total_columns"), "project", "left").join(r["relationship_summary"].select("project", "components", F.size("isolated_tables").alias("isolated"), "inactive_relationships"), "project", "left").na.fill(0)
    listed = F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("value"))
    return _all([
        section(_values(sums, ("Tables", "total_tables"), ("Relationships", "total_relationships"), ("Measures", "total_measures"), ("Schema", "schema_type"), ("Pages", "total_pages"), ("Score", "global_score"), ("Grade", "grade")), d, 11, "Model statistics", listed, [F.col("no")]),
        section(_values(classes, *((f"{c.capitalize()} tables", f"{c.lower()}_tables") for c in (*K.CLASSES, "UNKNOWN"))), d, 12, "Table distribution", listed, [F.col("no")]),
        section(_values(sums, ("Columns", "total_columns"), ("Used columns", "used_columns"), ("Unused columns", "total_unused"), ("Components", "components"), ("Isolated tables", "isolated"), ("Inactive relationships", "inactive_relationships")), d, 13, "Model health", listed, [F.col("no")]),
        _text(summary, d, 0, F.concat(F.lit("# Extended documentation: "), F.col("project")), F.concat(F.lit("Schema: "), F.col("schema_type")), F.format_string("%d tables, %d relationships, %d facts", "n_tables", "n_edges", "n_facts")),
        section(counts, d, 1, "Tables", _cells("table", "column_count", "measure_count", "table_kind", F.array_join("types", ", ")), [F.col("table")], ("Table", "Columns", "Measures", "Kind", "Types")),
        section(r["classifications"], d, 2, "Classes", _cells("table", "classification", "confidence", "reasoning"), [F.col("classification"), F.col("table")], ("Table", "Class", "Confidence", "Reason")),
        section(r["relationships"], d, 3, "Relationships", _cells(F.concat_ws(" -> ", "from_table", "to_table"), "cardinality", "cross_filter_direction"), [F.col("from_table"), F.col("to_table"), F.col("id")], ("Edge", "Cardinality", "Direction")),
        section(r["measures"], d, 4, "Measures", _cells("table", "name", F.concat(F.array_join(F.slice("dependencies", 1, 2), ", "), more), S.preview(F.col("expression"), 60)), [F.col("table"), F.col("name")], ("Table", "Measure", "Uses", "Expression")),
        section(r["unused_measures"], d, 5, "Unused measures", _cells("table", "name", "complexity_score", "reason"), [F.desc("complexity_score"), F.col("name"), F.col("table")], ("Table", "Measure", "Complexity", "Reason"), 10),
        section(r["columns"], d, 6, "Columns", _cells("table", "name", "data_type", "semantic_role", "is_hidden"), [F.col("table"), F.col("line"), F.col("name")], ("Table", "Column", "Type", "Role", "Hidden")),
        section(r["pages"], d, 7, "Pages", _cells("display_name", *(f"{k}_count" for k in ("chart", "table", "slicer", "button", "text", "card", "other", "hidden")), "visuals_count"), [F.col("page_id")], ("Page", "Charts", "Tables", "Slicers", "Buttons", "Texts", "Cards", "Other", "Hidden", "Visuals")),
        section(_use(r), d, 8, "Column use summary", F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("value")), [F.col("no")]),
        section(usage, d, 9, "Column use", _cells("table", "used_columns", "total_columns", "usage_percentage", "calculated_column_count", "measure_count", "table_kind"), [F.col("usage_percentage"), F.desc("unused_columns"), F.col("table")], ("Table", "Used", "Columns", "%", "Calculated", "Measures", "Kind")),
        section(flags, d, 10, "Data quality", _cells(F.concat_ws(" -> ", "from_table", "to_table"), F.array_join("quality_flags", ", ")), [F.col("from_table"), F.col("to_table"), F.col("id")], ("Edge", "Flags")),
        section(svg.embedded(svg.drawings(r)), d, 14, "Charts", F.col("line"), [F.col("document")]),
    ])


def compliance(r: Mapping[str, DataFrame]) -> DataFrame:
    """The compliance document: score, dimensions, issues with related codes, points, unused measures, next steps."""
    d = "compliance"
    found = r["issues"].where("code IS NOT NULL").join(scoring.related_codes(r["issues"]), ["project", "code"], "left")
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    items = _first(F.col("affected"))
    see = F.when(F.size("related") > 0, F.concat(F.lit(" (see "), F.array_join("related", ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- **"), F.col("code"), F.lit("** "), F.col("severity"), F.lit(" "), F.coalesce("detail", "rule"), F.when(items != "", F.concat(F.lit(": "), S.markdown_cell(items))).otherwise(""), see)
    return _all([
        _text(r["project_scores"], d, 0, F.concat(F.lit("# Compliance: "), F.col("project")), F.format_string("Score %d, grade %s (%s)", "global_score", "grade", "status")),
        section(r["dimension_scores"], d, 1, "Dimensions", _cells("dimension", "score", "weight", "weighted"), [F.col("dimension")], ("Dimension", "Score", "Weight", "Weighted")),
        section(found, d, 2, "Issues", line, [rank, F.col("dimension"), F.col("code")]),
        section(r["issues"], d, 3, "Points", _cells("dimension", F.replace("rule", F.lit("_"), F.lit(" ")), F.format_string("%+.1f", "points"), F.coalesce("detail", _first(F.col("affected")))), [F.col("dimension"), F.col("rule_no"), F.coalesce("detail", F.lit(""))], ("Dimension", "Rule", "Points", "Detail")),
        section(r["schema"], d, 6, "Notes", F.concat(F.lit("- The model dimension cannot score more than its schema type allows: "), F.col("schema_type")), [F.col("project")]),
        _text(r["project_scores"], d, 7, "", F.format_string("%d critical, %d warnings, %d infos. Scores start at 100 in each dimension.", "critical", "warnings", "infos")),
        section(r["unused_measures"], d, 4, "Unused measures", F.concat(F.lit("- "), S.markdown_cell(F.col("name"))), [F.desc("complexity_score"), F.col("name"), F.col("table")], limit=10),
        section(scoring.next_steps(r["issues"]), d, 5, "Next steps", F.concat(F.lit("- "), F.col("code"), F.lit(": "), F.col("recommendation")), [F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2), F.col("step_no")]),
    ])


def headings(lines: DataFrame) -> DataFrame:
    """project, document, section_no, line_no, level, title and slug of each heading.

    A slug is the title in lower case, without signs, with hyphens for spaces; of headings with
    one slug in a document the second is numbered -1, the third -2.
    """
    found = lines.where(F.col("line").rlike("^#{1,6} ")).withColumn("level", F.length(F.regexp_extract("line", "^(#+)", 1))).withColumn("title", F.trim(F.regexp_replace("line", "^#+ ", "")))
    base = F.replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))
    before = F.row_number().over(Window.partitionBy("project", "document", "base").orderBy("section_no", "line_no")) - 1
    named = found.withColumn("base", base).withColumn("before", before)
    slug = F.concat("base", F.when(F.col("before") > 0, F.concat(F.lit("-"), F.col("before"))).otherwise(""))
    return named.select("project", "document", "section_no", "line_no", "level", "title", slug.alias("slug"))


def contents(lines: DataFrame) -> DataFrame:
    """``lines`` with a list of contents behind each document's first section: a link to each heading below the title."""
    linked = headings(lines).where("level > 1")
    number = F.row_number().over(Window.partitionBy("project", "document").orderBy("section_no", "line_no"))
    title = F.regexp_replace("title", r"([\[\]])", r"\\$1")
    item = F.concat(F.repeat(F.lit("  "), F.col("level") - 2), F.lit("- ["), title, F.lit("](#"), F.col("slug"), F.lit(")"))
    items = linked.select("project", "document", F.lit(0).alias("section_no"), (number + 1000).cast("int").alias("line_no"), item.alias("line"))
    top = linked.select("project", "document").distinct().select("project", "document", F.lit(0).alias("section_no"), F.posexplode(F.array(F.lit("**Contents**"), F.lit(""))).alias("k", "line"))
    return lines.unionByName(top.select("project", "document", "section_no", (F.col("k") + 900).cast("int").alias("line_no"), "line")).unionByName(items)


def file_name(at: Column | None = None) -> Column:
    """A document's file: project, document and the time ``at`` (now, if none)."""
    safe = F.regexp_replace("project", r"[^\p{L}\p{N}._-]+", "_")
    return F.concat(safe, F.lit("_"), F.col("document"), F.lit("_"), F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss"), F.lit(".md"))


def all_documents(r: Mapping[str, DataFrame]) -> DataFrame:
    return contents(_all([technical(r), extended(r), compliance(r)]))
