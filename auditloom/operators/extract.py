"""Blocks to relations: columns, measures, partitions, tables, relationships, data sources, pages and visuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import dax
from ..functions import text as S

_COLUMN_TEXTS = ("sourceColumn", "formatString", "summarizeBy", "dataCategory", "description", "lineageTag", "sourceLineageTag")


def columns(objects: DataFrame) -> DataFrame:
    """A row for each column of each table file."""
    block, header = F.col("block"), F.col("header")
    rows = objects.where("kind = 'column'").select(
        "project",
        F.col("file_stem").alias("table"),
        S.header_name(header).alias("name"),
        F.coalesce(S.property_text(block, "dataType"), F.lit("string")).alias("data_type"),
        S.clean_column_expression(F.coalesce(S.header_expression(header), S.fenced(block), S.property_text(block, "expression"))).alias("expression"),
        *(S.property_text(block, key).alias(key) for key in _COLUMN_TEXTS),
        S.property_flag(block, "isHidden").alias("is_hidden"),
        S.annotations(block).alias("annotations"),
        "rel_path",
        "line",
    )
    rows = rows.withColumn("is_calculated", F.col("expression").isNotNull()).withColumn("is_key", K.is_key(F.col("name"), F.col("sourceColumn")))
    return rows.withColumn("semantic_role", K.semantic_role(F.col("name"), F.col("data_type"), F.col("is_key"), F.col("dataCategory"))).withColumn("summarize_by", F.coalesce("summarizeBy", F.lit("none")))


def measures(objects: DataFrame) -> DataFrame:
    """A row for each measure: expression on one line (null if none), its lines, metadata and lexical analysis."""
    block = F.col("block")
    rows = objects.where("kind = 'measure'").select(
        "project",
        F.col("file_stem").alias("table"),
        S.header_name(F.col("header")).alias("name"),
        S.clean_measure_expression(F.col("body")).alias("expression"),
        F.regexp_count(F.trim(F.coalesce("body", F.lit(""))), F.lit("\n")).alias("line_breaks"),
        S.property_text(block, "description").alias("description"),
        S.property_text(block, "displayFolder").alias("display_folder"),
        S.property_text(block, "formatString").alias("format_string"),
        (S.property_flag(block, "hidden") | S.property_flag(block, "isHidden")).alias("is_hidden"),
        S.property_text(block, "lineageTag").alias("lineage_tag"),
        "rel_path",
        "line",
    )
    return analysed(rows)


def analysed(rows: DataFrame) -> DataFrame:
    """Lexical columns of measures (name, expression): complexity, functions, references, findings."""
    e = F.col("expression")
    return (
        rows.withColumn("complexity_score", dax.complexity(e))
        .withColumn("functions_used", F.when(e.isNull(), F.array().cast("array<string>")).otherwise(dax.functions_used(e)))
        .withColumn("bracketed", dax.bracketed(e))
        .withColumn("candidates", dax.measure_candidates(e, F.col("name")))
        .withColumn("is_stub", dax.is_stub(e))
        .withColumn("expression_length", F.coalesce(F.length(e), F.lit(0)))
        .withColumn("expression_preview", S.preview(e))
        .withColumn("antipatterns", dax.antipatterns(e))
        .withColumn("highest_severity", dax.highest_severity(F.col("antipatterns")))
    )


def partitions(objects: DataFrame) -> DataFrame:
    block = F.col("block")
    return objects.where("kind = 'partition'").select(
        "project",
        F.col("file_stem").alias("table"),
        S.header_name(F.col("header")).alias("name"),
        S.property_text(block, "mode").alias("mode"),
        K.partition_source(block).alias("source_type"),
        (F.lower(block).contains("let") & F.lower(block).contains("in")).alias("has_m_expression"),
        F.upper(block).contains("DATATABLE").alias("has_datatable"),
        S.preview(block).alias("source_preview"),
        "line",
    )


def tables(files: DataFrame, objects: DataFrame, columns_: DataFrame, measures_: DataFrame, partitions_: DataFrame) -> DataFrame:
    """A row for each table file: counts, composition, type histogram and kind. Three small aggregates joined by table."""
    key = ["project", "table"]
    histogram = columns_.groupBy(*key, "data_type").count().groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("data_type", "count")))).alias("data_type_distribution"))
    of_columns = columns_.groupBy(*key).agg(
        F.count("*").alias("column_count"),
        F.count_if("is_hidden").alias("hidden_column_count"),
        F.count_if("is_calculated").alias("calculated_column_count"),
        F.count_if("is_key").alias("key_like_column_count"),
    )
    of_measures = measures_.groupBy(*key).agg(F.count("*").alias("measure_count"))
    of_partitions = partitions_.groupBy(*key).agg(F.count("*").alias("partition_count"))
    own = files.where(F.col("rel_path").rlike("^tables/")).select("project", F.col("file_stem").alias("table"), F.col("rel_path").alias("file"), "content")
    own = own.select(
        *key,
        "file",
        F.length("content").alias("raw_size_chars"),
        F.upper("content").contains("DATATABLE").alias("has_datatable"),
        K.has_calculated_signal(F.col("content")).alias("has_calculated_table_expression"),
        S.property_flag(F.regexp_extract("content", r"(?s)\A(.*?)(?:\n[ \t]+(?:column|measure|partition|hierarchy)[ ]|\z)", 1), "isHidden").alias("is_hidden"),
        S.annotations(F.col("content")).alias("annotations"),
    )
    out = own.join(of_columns, key, "left").join(of_measures, key, "left").join(of_partitions, key, "left").join(histogram, key, "left")
    out = out.na.fill(0, ["column_count", "hidden_column_count", "calculated_column_count", "key_like_column_count", "measure_count", "partition_count"])
    kind = K.table_kind(F.col("table"), F.col("column_count"), F.col("measure_count"), F.col("partition_count"), F.col("has_datatable"), F.col("has_calculated_table_expression"))
    return out.withColumn("table_kind", kind).withColumn(
        "composition",
        F.struct(F.col("column_count").alias("columns"), F.col("measure_count").alias("measures"), F.col("calculated_column_count").alias("calculated_columns"), F.col("hidden_column_count").alias("hidden_columns"), F.col("key_like_column_count").alias("key_like_columns")),
    )


def quality_flags(from_cardinality: Column, to_cardinality: Column, direction: Column, active: Column) -> Column:
    flags = F.array(
        F.when((from_cardinality == "many") & (to_cardinality == "many"), "MANY_TO_MANY"),
        F.when(direction == "Both", "BIDIRECTIONAL_FILTERING"),
        F.when(~active, "INACTIVE_RELATIONSHIP"),
        F.when((from_cardinality == "one") & (to_cardinality == "one"), "ONE_TO_ONE"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def relationships(objects: DataFrame) -> DataFrame:
    """A row for each relationship both of whose ends can be read."""
    p = S.properties(F.col("block"))
    get = lambda key: F.try_element_at(F.col("p"), F.lit(key))
    rows = objects.where("kind = 'relationship'").withColumn("p", p)
    rows = rows.select(
        "project",
        S.strip_quotes(F.col("header")).alias("id"),
        S.reference_table(get("fromColumn")).alias("from_table"),
        S.reference_column(get("fromColumn")).alias("from_column"),
        S.reference_table(get("toColumn")).alias("to_table"),
        S.reference_column(get("toColumn")).alias("to_column"),
        S.cardinality(get("fromCardinality"), "many").alias("from_cardinality"),
        S.cardinality(get("toCardinality"), "one").alias("to_cardinality"),
        F.coalesce(get("crossFilteringBehavior"), F.lit("singleDirection")).alias("cross_filtering_behavior"),
        get("securityFilteringBehavior").alias("security_filtering_behavior"),
        F.coalesce(F.lower(F.trim(get("isActive"))) == "true", F.lit(True)).alias("is_active"),
        F.coalesce(F.lower(F.trim(get("relyOnReferentialIntegrity"))) == "true", F.lit(False)).alias("rely_on_referential_integrity"),
        get("lineageTag").alias("lineage_tag"),
        "line",
    ).where("from_table IS NOT NULL AND from_column IS NOT NULL AND to_table IS NOT NULL AND to_column IS NOT NULL")
    rows = rows.withColumn("cross_filter_direction", S.filter_direction(F.col("cross_filtering_behavior"))).withColumn("cardinality", S.cardinality_label(F.col("from_cardinality"), F.col("to_cardinality")))
    return rows.withColumn("quality_flags", quality_flags(F.col("from_cardinality"), F.col("to_cardinality"), F.col("cross_filter_direction"), F.col("is_active")))


#: A connector call and its arguments, and the connectors whose arguments say a database, an address or a path.
_CALL = r"(?s)([A-Za-z0-9_]+\.[A-Za-z0-9_]+)\s*\((.*?)\)"
#: The same calls, tried once a word: SQL has no such signs.
_WORD_CALL = r"(?s)(?<![A-Za-z0-9_])([A-Za-z0-9_]++\.[A-Za-z0-9_]++)\s*+\((.*?)\)"
DATABASE_CALLS = ("sql.database", "analysisservices.database", "oracle.database", "postgresql.database", "mysql.database", "commondataservice.database")
WEB_CALLS = ("web.contents", "web.page", "odata.feed", "sharepoint.files", "sharepoint.contents", "sharepoint.tables")
PATH_CALLS = ("file.contents", "excel.workbook", "csv.document", "folder.files", "folder.contents")


def source_rows(files: DataFrame) -> DataFrame:
    """Each connector call and each plain ``source = ...`` line of the files as a source, before grouping."""
    base = files.select("project", "rel_path", "content")
    named = base.select("*", F.regexp_extract_all("content", F.lit(r"(?ms)^\s*expression\s+('[^']+'|\S+)\s*=(.*?)(?=^\s*expression\s|\z)"), F.lit(0)).alias("named"))
    parts = F.when(F.size("named") > 0, F.transform("named", lambda x: F.struct(S.strip_quotes(F.regexp_extract(x, r"expression\s+('[^']+'|\S+)\s*=", 1)).alias("expression_name"), x.alias("body")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("expression_name"), F.col("content").alias("body"))))
    bodies = named.select("project", "rel_path", F.explode(parts).alias("part")).select("project", "rel_path", "part.*")
    calls = F.regexp_extract_all("body", F.lit(_WORD_CALL), F.lit(0))
    called = bodies.select("project", "rel_path", "expression_name", F.posexplode(calls).alias("place", "call"))
    called = called.select("project", "rel_path", "expression_name", "place", F.regexp_extract("call", _WORD_CALL, 1).alias("connector"), F.regexp_extract("call", _WORD_CALL, 2).alias("args"))
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*source\s*=") & ~x.rlike(r"[A-Za-z0-9_]+\.[A-Za-z0-9_]+\s*\("))
    plain = base.select("project", "rel_path", F.lit(None).cast("string").alias("expression_name"), F.posexplode(lines).alias("place", "line"))
    plain = plain.select("project", "rel_path", "expression_name", (F.col("place") + 1_000_000).alias("place"), F.lit("source_assignment").alias("connector"), F.trim(F.regexp_replace("line", r"(?i)^\s*source\s*=", "")).alias("args"))
    rows = called.unionByName(plain)
    text = F.concat_ws(" ", "connector", "args")
    rows = rows.withColumn("type", K.connector_type(F.col("connector"), text)).withColumn("confidence", K.connector_confidence(F.col("connector"), text)).where("type <> 'Other'")
    values, low = S.quoted_values(F.col("args")), F.lower("connector")
    database, web, path = low.isin(*DATABASE_CALLS), low.isin(*WEB_CALLS), low.isin(*PATH_CALLS)
    first, second = F.get(F.col("v"), F.lit(0)), F.get(F.col("v"), F.lit(1))
    attributes = F.struct(
        F.when(database, first).alias("server"),
        F.when(database, second).alias("database"),
        F.when(web, first).alias("url"),
        F.when(web, S.url_host(first)).alias("domain"),
        F.when(path, first).alias("path"),
        F.when(path, S.path_suffix(first)).alias("file_extension"),
        F.when(~(database | web | path), first).alias("first_argument"),
        F.size("v").alias("argument_count"),
    )
    rows = rows.withColumn("v", values).withColumn("attributes", attributes).drop("v")
    return rows.withColumn("id", S.source_id(F.col("connector"), F.col("args"), F.col("rel_path"), F.col("expression_name"))).withColumn("definition", S.preview(F.concat(F.col("connector"), F.lit("("), F.col("args"), F.lit(")"))))


def datasources(files: DataFrame) -> DataFrame:
    """One row for each distinct source: the first one's text, how often it occurs, where, and the best confidence."""
    a = F.col("attributes")
    blank = lambda c: F.coalesce(c, F.lit(""))
    key = S.dedup_key(F.col("type"), F.col("connector"), *(blank(a[c]) for c in ("server", "database", "url", "domain", "path")))
    order = F.struct("rel_path", "place")
    grouped = source_rows(files).withColumn("key", key).groupBy("project", "key").agg(
        F.min_by(F.struct("id", "type", "connector", "rel_path", "expression_name", "attributes", "definition"), order).alias("first"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("occurrences"),
        F.sort_array(F.collect_set(F.struct(F.col("rel_path").alias("source_file"), "expression_name"))).alias("references"),
    )
    out = grouped.select("project", "first.*", "confidence", "occurrences", "references")
    return out.withColumn("privacy_note", K.privacy_note(F.col("type")))


def datasource_summary(sources: DataFrame) -> DataFrame:
    """project, totals, flags and quality texts."""
    kinds = F.collect_set("type")
    some = lambda types: F.bool_or(F.col("type").isin(*types))
    out = sources.groupBy("project").agg(
        F.count("*").alias("total_datasources"),
        F.bool_or(F.col("connector") != "source_assignment").alias("has_m_queries"),
        some(K.FILE_TYPES).alias("has_file_based_sources"),
        some(K.CLOUD_TYPES).alias("has_cloud_sources"),
        some(K.DATABASE_TYPES).alias("has_database_sources"),
        some(K.WEB_TYPES).alias("has_web_sources"),
        F.count_if(F.col("confidence") < 0.7).alias("low_confidence"),
        F.array_sort(kinds).alias("types"),
    )
    keep = lambda *cases: F.filter(F.array(*cases), lambda x: x.isNotNull())
    return out.withColumn(
        "issues",
        keep(
            F.when(F.size("types") > 3, F.concat(F.lit("Several source types: "), F.array_join("types", ", "))),
            F.when(F.col("low_confidence") > 0, F.format_string("%d sources found with low confidence", "low_confidence")),
        ),
    ).withColumn(
        "recommendations",
        keep(
            F.when(F.size("types") > 3, "Check gateway and privacy levels of mixed sources."),
            F.when(F.col("has_file_based_sources"), "Check that file paths can be reached on refresh."),
            F.when(F.col("has_web_sources"), "Check sign-in and scheduled refresh of web sources."),
            F.when(F.col("low_confidence") > 0, "Review sources found with low confidence."),
        ),
    )


def datasource_counts(sources: DataFrame) -> DataFrame:
    """project, what (type or connector), name, n."""
    by = lambda c: sources.groupBy("project", F.col(c).alias("name")).agg(F.count("*").alias("n")).select("project", F.lit(c).alias("what"), "name", "n")
    return by("type").unionByName(by("connector"))


#: A brace that neither a quote nor another brace follows.
_NO_JSON = r'\A[ \t\r\n]*+\{[ \t\r\n]*+[^"}]'
_PROJECTIONS = "array<struct<nativeQueryRef:string>>"


def visuals(report: DataFrame) -> DataFrame:
    """A row for each visual folder; what cannot be parsed has a null type, and still counts."""
    # an error of the parser costs as much as many visuals: what cannot be an object does not reach it
    raw = report.where("visual_id IS NOT NULL").withColumn("v", F.when(~F.col("content").rlike(_NO_JSON), F.try_parse_json("content")))
    refs = lambda role: F.coalesce(F.try_variant_get("v", f"$.visual.query.queryState.{role}.projections", _PROJECTIONS)["nativeQueryRef"], F.array().cast("array<string>"))
    typed = raw.select(
        "project",
        "page_id",
        "visual_id",
        F.try_variant_get("v", "$.visual.visualType", "string").alias("visual_type"),
        F.coalesce(F.try_variant_get("v", "$.isHidden", "boolean"), F.lit(False)).alias("is_hidden"),
        refs("Values").alias("of_values"),
        refs("Rows").alias("of_rows"),
        refs("Columns").alias("of_columns"),
        refs("Category").alias("of_category"),
    )
    category = F.when(F.col("visual_type").isNotNull(), K.visual_category(F.col("visual_type")))
    whole = F.when(category == "TABLE", F.concat("of_rows", "of_columns", "of_values")).otherwise(F.concat("of_values", "of_rows", "of_columns"))
    fields = F.array_except(F.concat(whole, F.col("of_category")), F.array(F.lit(None).cast("string"), F.lit("")))  # each once, in order
    out = typed.select("project", "page_id", "visual_id", "visual_type", "is_hidden", category.alias("category"), fields.alias("all_fields"))
    shown = F.when(F.col("category").isin("CHART", "TABLE"), F.slice("all_fields", 1, 3)).otherwise(F.array().cast("array<string>"))
    return out.withColumn("fields", shown).withColumn("display_name", visual_name(F.col("visual_type"), F.col("fields")))


#: Names of chart types.
_LABELS = {
    "columnChart": "Column Chart", "lineChart": "Line Chart", "areaChart": "Area Chart", "barChart": "Bar Chart", "waterfallChart": "Waterfall Chart",
    "scatterChart": "Scatter Plot", "bubbleChart": "Bubble Chart", "pieChart": "Pie Chart", "donutChart": "Donut Chart", "ribbonChart": "Ribbon Chart", "gaugeChart": "Gauge",
}


def visual_name(visual_type: Column, fields: Column) -> Column:
    label = K.first_of([(visual_type == k, v) for k, v in _LABELS.items()], F.initcap(visual_type))
    return F.when(F.size(fields) > 0, F.concat(label, F.lit(": "), F.array_join(F.slice(fields, 1, 2), ", "))).otherwise(label)


def pages(report: DataFrame, visuals_: DataFrame) -> DataFrame:
    """A row for each page, named by its own file or else its id, with counts by category; listed pages without visuals too."""
    own = report.where("visual_id IS NULL AND page_id IS NOT NULL").groupBy("project", "page_id").agg(F.max(F.try_variant_get(F.try_parse_json("content"), "$.displayName", "string")).alias("display_name"))
    listed = report.where("page_id IS NULL").withColumn("v", F.try_parse_json("content"))
    order = F.coalesce(F.try_variant_get("v", "$.pageOrder", "array<string>"), F.transform(F.try_variant_get("v", "$", "array<struct<id:string,name:string>>"), lambda x: F.coalesce(x["id"], x["name"])))
    every = listed.select("project", F.explode(order).alias("page_id")).unionByName(own.select("project", "page_id")).unionByName(visuals_.select("project", "page_id")).distinct()
    count = lambda category: F.count_if(F.col("category") == category).alias(f"{category.lower()}_count")
    counts = visuals_.groupBy("project", "page_id").agg(
        F.count("*").alias("visuals_count"), *(count(c) for c in ("CHART", "TABLE", "SLICER", "BUTTON", "TEXT", "CARD")), F.count_if(F.col("category") == "OTHER").alias("other_count"),
        F.count_if("is_hidden").alias("hidden_count"), F.array_sort(F.collect_list("visual_id")).alias("visual_ids"),
    )
    out = every.join(own, ["project", "page_id"], "left").join(counts, ["project", "page_id"], "left").withColumn("display_name", F.coalesce("display_name", "page_id"))
    return out.na.fill(0)


def category_totals(pages_: DataFrame) -> DataFrame:
    """project, pages and the visuals of all its pages by category."""
    kinds = ("visuals", "chart", "table", "slicer", "button", "text", "card", "other", "hidden")
    return pages_.groupBy("project").agg(F.count("*").alias("pages"), *(F.sum(f"{k}_count").cast("long").alias(f"{k}_count") for k in kinds))


def page_fields(report: DataFrame) -> DataFrame:
    """project, page_id, name: every bracketed name and every field reference anywhere in a visual's definition, however deep."""
    text = F.coalesce("content", F.lit(""))
    brackets = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]\"{}:,]+)\]"), F.lit(1)), lambda x: F.trim(x))
    references = F.regexp_extract_all(text, F.lit(r'"(?:nativeQueryRef|queryRef|Property)"\s*:\s*"([^"]+)"'), F.lit(1))
    rows = report.where("visual_id IS NOT NULL").select("project", "page_id", F.explode(F.concat(brackets, references)).alias("name"))
    return rows.where("name <> ''").distinct()


def ordered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``position``: the place in its project by type, connector, server, address and path; what is missing is empty."""
    keys = [F.coalesce(c, F.lit("")) for c in ("type", "connector", "attributes.server", "attributes.url", "attributes.path")]
    order = Window.partitionBy("project").orderBy(*keys, F.coalesce("attributes.database", F.lit("")))
    return sources.withColumn("position", F.row_number().over(order))
