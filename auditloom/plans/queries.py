"""The driver's queries on the operators of the audit: on the catalogue of the tables, on their rows, and on projects written from their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import dax
from ..functions import text as S
from ..operators import blocks, extract, measures, model, scoring
from ..sources import catalog, rules, tmdl
from ..sources.shared import dealt
from . import audit, charts, documents, prompts, row_projects, svg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Lines whose pairs one task makes.
LINES = 1 << 18
#: ASCII white space, spelt out: the same in both engines.
SPACE = r"[ \t\r\n\f\x0b]+"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Catalogue


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    columns, edges = catalog.read_columns(spark, sf_dir), catalog.read_edges(spark)
    return columns, edges, model.classify(model.profile(columns, edges))


@query
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.read_columns(spark, sf_dir)
    key = K.is_key(F.col("name"))
    return c.select("table", "name", "data_type", key.alias("is_key"), K.semantic_role(F.col("name"), F.col("data_type"), key).alias("role"))


@query
def datatype_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.datatype_bars(catalog.read_columns(spark, sf_dir)).select("display_type", "n")


@query
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.profile(catalog.read_columns(spark, sf_dir), catalog.read_edges(spark))
    return p.select("table", "columns", "numeric_columns", "string_columns", "date_columns", "relationships_from", "relationships_to", "is_isolated", "numeric_ratio", "string_ratio")


@query
def table_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)[2].select("table", "classification", "confidence", *(F.col(c).cast("long").alias(c.lower()) for c in K.CLASSES))


@query
def schema_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, classes = _classes(spark, sf_dir)
    return model.schema_type(classes, edges).select("n_tables", "n_facts", "n_edges", "fact_dimension", "dimension_dimension", "schema_type")


@query
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, classes = _classes(spark, sf_dir)
    return model.components(classes, edges).select("table", "component")


@query
def isolated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, classes = _classes(spark, sf_dir)
    real = classes.where(~F.col("classification").isin("CALCULATION", "PARAMETER")).select("project", "table")
    return model.isolated(classes, edges).join(real, ["project", "table"], "left_semi").select("table")


@query
def shared_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, classes = _classes(spark, sf_dir)
    return model.shared_dimensions(edges, classes).select("dimension", "n_edges")


@query
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, edges, classes = _classes(spark, sf_dir)
    found = scoring.issues(scoring.model_findings(classes, edges, columns), rules.read_rules(spark))
    return found.select("rule", "points", F.coalesce("code", F.lit("-")).alias("code"))


@query
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, edges, classes = _classes(spark, sf_dir)
    found = scoring.issues(scoring.model_findings(classes, edges, columns), rules.read_rules(spark))
    scores = scoring.dimension_scores(classes.select("project").distinct(), found, model.schema_type(classes, edges))
    return scoring.project_scores(scores).select("global_score", "grade")


@query
def complexity_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, classes = _classes(spark, sf_dir)
    tables = classes.select("project", "table", F.col("columns").alias("column_count"), F.col("measures").alias("measure_count"))
    return charts.heatmap(tables, edges).select("table", "column_metric", "measure_metric", "relationship_metric", "rank")


@query
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.class_shares(_classes(spark, sf_dir)[2]).select("classification", "n", "share")


# The same algebra on rows


@query
def hub_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("degree"))
    return n.orderBy(F.desc("degree"), "l_suppkey").limit(5)


@query
def unused_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(used, "o_orderkey", "left_anti")


@query
def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for child, key, parent, parent_key in catalog.EDGES:
        left = _table(spark, sf_dir, child).select(F.col(key).alias("k"))
        orphans = left.join(_table(spark, sf_dir, parent).select(F.col(parent_key).alias("k")), "k", "left_anti")
        row = orphans.agg(F.count("*").alias("orphans")).select(F.lit(f"{child}.{key}").alias("edge"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def _customer_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as columns of their nation's table, orders as expressions that name one: which customers are used."""
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", F.trim("n_name").alias("table"))
    customers = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    columns = customers.select(F.lit("shop").alias("project"), "table", F.col("c_custkey").cast("string").alias("name"))
    orders = _table(spark, sf_dir, "orders").select(F.lit("shop").alias("project"), F.concat(F.lit("order "), "o_orderkey").alias("name"), F.array(F.col("o_custkey").cast("string")).alias("bracketed"))
    return measures.column_usage(columns, orders, names=False)


@query
def usage_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _customer_usage(spark, sf_dir)
    return u.select("table", "total_columns", "used_columns", "unused_columns", F.col("usage_percentage").cast("long").alias("usage_percentage"), "first_used")


@query
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.usage_summary(_customer_usage(spark, sf_dir)).drop("project")


@query
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey")
    return rows.agg(F.min(F.struct("l_orderkey", "l_linenumber"))["l_orderkey"].alias("first_order"), F.count("*").alias("occurrences"), F.max("l_extendedprice").alias("best"))


@query
def source_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", S.source_id(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("source_id"))


@query
def capped_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = _table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0)
    return c.select("c_custkey", S.capped(F.col("n"), 2.0, 15.0).alias("points"), S.clamp(F.lit(100.0) - F.col("n") * 7).alias("score"))


@query
def grade_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.clamp(F.col("c_acctbal") / 100)
    return _table(spark, sf_dir, "customer").groupBy(K.grade(score).alias("grade")).agg(F.count("*").alias("n"))


@query
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues of their user: scores, weights and severity counts of the four dimensions."""
    severity = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    dimension = F.element_at(F.array(*map(F.lit, rules.WEIGHTS)), (F.col("event_id") % 4 + 1).cast("int"))
    issues = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("project"), dimension.alias("dimension"), severity.alias("severity"), F.lit(-2.5).alias("points"))
    users = issues.select("project").distinct()
    kind = F.when(F.col("project").cast("long") % 2 == 0, "GALAXY").otherwise("FLAT")
    out = scoring.dimension_scores(users, issues, users.select("project", kind.alias("schema_type")))
    return out.select("project", "dimension", "score", "weighted", "critical", "warnings", "infos")


@query
def project_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores by project."""
    rows = severity_rollup(spark, sf_dir)
    return scoring.project_scores(rows).select("project", "global_score", "grade", "status", "critical", "warnings", "infos")


@query
def issue_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("event_type = 'error'")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", "user_id", F.format_string("E%03d", number).alias("code"))


@query
def first_k_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_name").alias("name"))
    return scoring.first_affected(rows, "name").select(F.col("project").alias("c_nationkey"), F.array_join("first", ", ").alias("first"), "more")


def _shared_parts(rows: DataFrame) -> DataFrame:
    """Pairs of suppliers with two or more parts in common. Parts are counted once: distinct pairs go into the join.

    A task gets about ``LINES`` lines, however few bytes they have, as each meets many others. What they make is dealt
    by pair before it is counted: a task counts all of a pair, and holds its share of the pairs, not all that a join makes.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // LINES + 1)
    pairs = rows.select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey").distinct()
    other = pairs.withColumnRenamed("l_suppkey", "other")
    met = pairs.join(other, "l_partkey").where("l_suppkey < other").select("l_suppkey", "other")
    return met.repartition(tasks, "l_suppkey", "other").groupBy("l_suppkey", "other").agg(F.count("*").alias("shared_parts")).where("shared_parts >= 2")


@query
def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared_parts(_table(spark, sf_dir, "lineitem"))


@query
def related_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues of their customer: others of the same priority that a line's part ties to them."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("part"))
    parts = lines.groupBy("o_orderkey").agg(F.collect_set("part").alias("affected"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("severity"), (F.col("o_custkey") % 100).cast("string").alias("project"))
    found = orders.join(parts, "o_orderkey").select("project", "severity", F.format_string("D%d", "o_orderkey").alias("code"), "affected")
    return scoring.related_codes(found).select("project", "code", F.array_join("related", ",").alias("related"))


@query
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.explode(S.name_tokens(F.col("p_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", K.keyword_type(F.col("url")).alias("family"), K.connector_confidence(F.lit(""), F.col("url")).alias("confidence"))


@query
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").groupBy(S.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count(S.path_suffix(F.col("url"))).alias("with_suffix"))


@query
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"))


@query
def paren_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", dax.paren_depth(F.col("text")).cast("long").alias("depth"))


@query
def text_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored as if they were expressions."""
    return _table(spark, sf_dir, "documents").select("doc_id", dax.complexity(F.col("text")).alias("complexity"))


@query
def token_usage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select(F.col("role").alias("project"), F.col("text").alias("expression"))
    return prompts.token_usage(said).select("project", "token", "n", F.col("rank").cast("long").alias("rank"))


@query
def property_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as blocks of properties, read back."""
    quoted = F.concat(F.lit("\tname: '"), "p_name", F.lit("'\n\t\tbrand:  "), "p_brand", F.lit(" \r\n"))
    block = F.concat(quoted, F.when(F.col("p_partkey") % 3 == 0, F.lit("\tisHidden\n")).when(F.col("p_partkey") % 3 == 1, F.lit("\tisHidden: false\n")).otherwise(""), F.lit('\tkind: "'), "p_type", F.lit('"\n\tannotation Size = x\n\tname: second'))
    b = dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey").select("p_partkey", block.alias("b"))
    pairs = S.properties(F.col("b"))
    return b.select(
        "p_partkey", S.property_text(F.col("b"), "name").alias("name"), S.property_text(F.col("b"), "brand").alias("brand"), S.property_text(F.col("b"), "kind").alias("kind"),
        S.property_flag(F.col("b"), "isHidden").alias("hidden"), S.property_text(F.col("b"), "none").alias("none"), F.try_element_at(pairs, F.lit("name")).alias("last_name"), S.annotations(F.col("b"))[0]["value"].alias("size"),
    )


@query
def quoted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.quoted_values(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.size(v).cast("long").alias("n"), F.get(v, F.lit(0)).alias("first"), F.get(v, F.size(v) - 1).alias("last"))


@query
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.line_blocks(_table(spark, sf_dir, "documents"), "doc_id", "text", "^[A-Z]")


@query
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return _table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query
def stub_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(dax.is_stub(F.col("text"))).alias("stubs"), F.count_if(F.length("text") < 100).alias("short"), F.count("*").alias("total"))


@query
def label_join_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), F.bround(F.try_divide(F.sum("quality").cast("double"), F.count("quality").cast("double")), 4).alias("good_rate"))


@query
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k).alias(k)
    n = _table(spark, sf_dir, "events").groupBy("user_id").agg(kind("click"), kind("view"), kind("purchase"))
    return n.withColumn("dominant", K.dominant_visual(F.col("click"), F.col("view"), F.col("purchase")))


@query
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as classes of one project."""
    states = _table(spark, sf_dir, "orders").select(F.lit("shop").alias("project"), F.col("o_orderstatus").alias("classification"))
    return charts.class_shares(states).select(F.col("classification").alias("o_orderstatus"), "n", "share")


@query
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as measures, orders and events as what uses them: those that nothing uses, with the risk of deleting them."""
    name = lambda c: F.concat(F.lit("c"), c).alias("name")
    customers = _table(spark, sf_dir, "customer").select(
        F.lit("shop").alias("project"), name("c_custkey"), (F.col("c_acctbal") < 0).alias("is_stub"), (F.col("c_acctbal") / 500).alias("complexity_score"), (F.col("c_mktsegment") == "BUILDING").alias("is_base_measure")
    )
    edges = _table(spark, sf_dir, "orders").select(F.lit("shop").alias("project"), F.concat(F.lit("o"), "o_orderkey").alias("name"), F.concat(F.lit("c"), "o_custkey").alias("dependency"))
    shown = _table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.lit("shop").alias("project"), F.array(F.concat(F.lit("t[c"), "user_id", F.lit("]"))).alias("all_fields"))
    return measures.unused(customers, edges, shown).select("name", "cleanup_risk", "reason")


# Projects written from the tables


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = row_projects.files(spark, sf_dir)
    return files.where(~K.is_internal_table(F.col("file_stem")))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.dealt_objects(_files(spark, sf_dir), blocks.PARTS)


@query
def tmdl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = extract.columns(_objects(spark, sf_dir))
    notes = F.array_join(F.transform("annotations", lambda a: F.concat_ws("=", a["name"], a["value"])), ",")
    return c.select("project", "table", "name", "data_type", "is_calculated", "expression", "summarize_by", "is_hidden", "is_key", "semantic_role", notes.alias("annotations"), F.col("line").cast("long").alias("line"))


@query
def tmdl_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = extract.measures(_objects(spark, sf_dir))
    return m.select(
        "project", "table", "name", "expression", "format_string", "description", "display_folder", "is_hidden", "complexity_score", "is_stub", F.col("expression_length").cast("long").alias("expression_length"),
        F.array_join("functions_used", ",").alias("functions_used"), F.array_join("bracketed", ",").alias("bracketed"), "highest_severity",
    )


@query
def tmdl_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.partitions(_objects(spark, sf_dir)).select("project", "table", "name", "mode", "source_type", "has_m_expression", "has_datatable")


@query
def tmdl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, objects = _files(spark, sf_dir), _objects(spark, sf_dir)
    c, m, p = extract.columns(objects), extract.measures(objects), extract.partitions(objects)
    t = extract.tables(files, objects, c, m, p)
    types = F.array_join(F.transform(F.map_entries("data_type_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t.select(
        "project", "table", "file", "column_count", "measure_count", "partition_count", "hidden_column_count", "calculated_column_count", "key_like_column_count", "table_kind", "is_hidden",
        F.coalesce(types, F.lit("")).alias("types"), F.col("raw_size_chars").cast("long").alias("raw_size_chars"),
    )


@query
def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.relationships(_objects(spark, sf_dir)).select("project", "id", "from_table", "from_column", "to_table", "to_column", "cardinality", "cross_filter_direction", "is_active", F.array_join("quality_flags", ",").alias("flags"))


@query
def datasources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.datasources(tmdl.source_files(row_projects.files(spark, sf_dir)))
    return d.select("project", "type", "connector", "confidence", "occurrences", "attributes.server", "attributes.database", "attributes.url", "attributes.domain", "attributes.path", "attributes.file_extension")


@query
def datasource_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.datasource_counts(extract.datasources(tmdl.source_files(row_projects.files(spark, sf_dir))))


@query
def datasource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.datasource_summary(extract.datasources(tmdl.source_files(row_projects.files(spark, sf_dir))))
    return d.select("project", "total_datasources", "has_m_queries", "has_file_based_sources", "has_cloud_sources", "has_database_sources", "has_web_sources", "low_confidence", F.array_join("types", ",").alias("types"))


@query
def report_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.visuals(row_projects.report(spark, sf_dir)).select("project", "page_id", "visual_id", "visual_type", "is_hidden", "category", F.array_join("all_fields", ",").alias("all_fields"), F.size("fields").cast("long").alias("shown"))


@query
def visual_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = extract.visuals(row_projects.report(spark, sf_dir))
    return extract.pages(row_projects.report(spark, sf_dir), v).select("project", "page_id", "display_name", "visuals_count", "chart_count", "table_count", "card_count", "slicer_count", "text_count", "other_count", "hidden_count")


def _audit(spark: SparkSession, sf_dir: str) -> audit.Relations:
    return audit.relations(row_projects.files(spark, sf_dir), row_projects.report(spark, sf_dir), computed=True)


@query
def measure_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _audit(spark, sf_dir)["measures"]
    return m.select("project", "name", F.col("dependency_depth").cast("long").alias("depth"), F.col("dependents_count").cast("long").alias("dependents"), "is_leaf_measure", "architectural_role", "architectural_complexity")


@query
def measure_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["measure_edges"].select("project", "name", "dependency")


@query
def unused_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["unused_measures"].select("project", "name", "cleanup_risk")


@query
def unused_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["unused_summary"]


@query
def antipatterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.measures(_objects(spark, sf_dir)).select("project", "name", F.explode("antipatterns").alias("a"))
    return found.select("project", "name", "a.code", "a.severity", F.col("a.occurrences").cast("long").alias("occurrences"))


@query
def table_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles and classes of the projects' tables."""
    c = _audit(spark, sf_dir)["classifications"]
    return c.select(
        "project", "table", "classification", "confidence", "columns", "measures", "relationships_from", "relationships_to", "is_isolated", F.col("calculated_columns").alias("calculated"), "summarized_columns", "numeric_ratio", "date_ratio"
    )


@query
def project_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _audit(spark, sf_dir)
    return r["relationship_summary"].select(
        "project", "total_tables", "total_relationships", "active_relationships", "inactive_relationships", "components", F.array_join("isolated_tables", ",").alias("isolated_tables"), "schema_type", "average_classification_confidence"
    )


@query
def shared_dimensions_of_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _audit(spark, sf_dir)
    return model.shared_dimensions(r["relationships"], r["classifications"])


@query
def hub_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables of each project that most active relationships touch."""
    return model.hubs(_audit(spark, sf_dir)["relationships"]).select("project", "table", "degree", F.col("rank").cast("long").alias("rank"))


@query
def lowest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables of each project whose columns are used least."""
    return measures.lowest_usage(_audit(spark, sf_dir)["column_usage"]).select("project", "table", "unused_columns", F.col("rank").cast("long").alias("rank"))


@query
def datatype_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.datatype_statistics(_audit(spark, sf_dir)["columns"])


@query
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visuals by category over all pages of a report."""
    return extract.category_totals(_audit(spark, sf_dir)["pages"])


@query
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed names and references anywhere in a visual's definition."""
    return extract.page_fields(row_projects.report(spark, sf_dir))


@query
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["issues"].select("project", "dimension", "rule", "points", F.coalesce("severity", F.lit("-")).alias("severity"), F.coalesce("code", F.lit("-")).alias("code"), F.array_join("affected", ";").alias("affected"))


@query
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["dimension_scores"].select("project", "dimension", "score", "weighted")


@query
def audit_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["project_scores"].select("project", "global_score", "grade", "status")


@query
def column_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["column_usage"].select("project", "table", "total_columns", "used_columns", F.array_join("used_column_names", ",").alias("used"), F.array_join("unused_column_names", ",").alias("unused"))


@query
def compliance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.compliance(_audit(spark, sf_dir)).select("project", "document", "section_no", "line_no", "line")


@query
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _audit(spark, sf_dir)
    r.prepare(*documents.RELATIONS)
    return documents.technical(r).unionByName(documents.extended(r)).select("project", "document", "section_no", "line_no", "line")


@query
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.prompts(_audit(spark, sf_dir)).select("project", "block", "prompt")


@query
def chart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five charts of each project as lines of SVG."""
    return svg.drawings(_audit(spark, sf_dir))


@query
def unused_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each table that no measure and no visual names."""
    r = _audit(spark, sf_dir)
    return measures.unused_columns(measures.column_hits(r["columns"], r["measures"], r["visuals"]))


@query
def datasource_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.ordered_sources(_audit(spark, sf_dir)["datasources"])
    return d.select("project", "position", "type", "connector", "attributes.server", "attributes.url", "attributes.path")


@query
def measures_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.by_table(extract.measures(_objects(spark, sf_dir))).select("project", "table", "position", "name")


@query
def first_seen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words without repeats, in order."""
    words = F.split(F.coalesce("text", F.lit("")), "[ \\n]")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(S.first_seen(words), " ").alias("words"))
