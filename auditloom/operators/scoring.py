"""Rules to counts to points to issues to scores: one row for each project and rule.

A rule counts its findings; points are the count times the rule's rate, at most
its cap. A dimension starts at 100, penalties subtract, bonuses add; the model
dimension is bounded by its schema type; all are clamped to 0 to 100. Empty
inputs score 100.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import dax
from ..functions import text as S
from ..sources import rules as R
from . import model as M

FINDING = "project string, dimension string, rule string, n double, detail string, affected array<string>, severity_given string"


def _finding(rows: DataFrame, dimension: str, rule: str, n: Column, affected: Column | None = None, detail: Column | None = None, severity: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        "project", F.lit(dimension).alias("dimension"), F.lit(rule).alias("rule"), n.cast("double").alias("n"),
        (null if detail is None else detail).alias("detail"), (F.array().cast("array<string>") if affected is None else affected).alias("affected"), (null if severity is None else severity).alias("severity_given"),
    ).where("n > 0")


def _findings(wide: DataFrame, dimension: str, *rules: tuple[str, Column, Column | None]) -> DataFrame:
    """One row a project becomes one finding a rule (rule, n, affected) that has any: a single pass for all rules of an input."""
    none = F.array().cast("array<string>")
    items = F.array(*(F.struct(F.lit(rule).alias("rule"), n.cast("double").alias("n"), (none if affected is None else F.coalesce(affected, none)).alias("affected")) for rule, n, affected in rules))
    null = F.lit(None).cast("string")
    rows = wide.select("project", F.explode(items).alias("f")).where("f.n > 0")
    return rows.select("project", F.lit(dimension).alias("dimension"), "f.rule", "f.n", null.alias("detail"), "f.affected", null.alias("severity_given"))


def _sorted(when: Column, name: str) -> Column:
    return F.array_sort(F.collect_set(F.when(when, F.col(name))))


def _flag(when: Column) -> Column:
    return F.when(when, 1).otherwise(0)


def first_affected(rows: DataFrame, name: str, k: int = 3) -> DataFrame:
    """project, first (the ``k`` smallest distinct names, sorted), more (how many others): ranked with a limit, no group is collected."""
    names = rows.select("project", name).distinct()
    rank = F.row_number().over(Window.partitionBy("project").orderBy(name))
    first = names.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("project").agg(F.array_sort(F.collect_list(name)).alias("first"))
    total = names.groupBy("project").agg(F.count("*").alias("total"))
    both = total.join(first, total["project"].eqNullSafe(first["project"]))
    return both.select(total["project"], "first", (F.col("total") - F.size("first")).cast("long").alias("more"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def model_findings(classes: DataFrame, edges: DataFrame, columns: DataFrame, names: R.RuleSet | None = None) -> DataFrame:
    """Findings about tables and relationships."""
    limits = (names or R.RuleSet()).limits
    c = F.col
    shared = M.shared_dimensions(edges, classes).groupBy("project").agg(F.count("*").alias("shared"))
    counts = M.class_counts(classes).select("project", "average_confidence", "bridge_tables")
    t = M.schema_type(classes, edges).join(counts, "project").join(shared, "project", "left").na.fill(0, ["shared"])
    named = edges.withColumn("label", F.concat_ws(" -> ", "from_table", "to_table"))
    many = (c("from_cardinality") == "many") & (c("to_cardinality") == "many")
    both, off = F.lower("cross_filter_direction").isin("both", "bothdirections"), ~c("is_active")
    links = named.groupBy("project").agg(
        F.count_if(many).alias("many"), _sorted(many, "label").alias("many_names"), F.count_if(both).alias("both"), _sorted(both, "label").alias("both_names"), F.count_if(off).alias("off"), _sorted(off, "label").alias("off_names")
    )
    helper = c("classification").isin("CALCULATION", "PARAMETER")
    alone = c("is_isolated") & ~(helper | c("table").rlike("^(_|param|Param)"))
    fact, low = (c("classification") == "FACT") & (c("calculated_columns") > 0), (c("confidence") < limits["low_confidence_classification"]) & ~helper
    own = classes.groupBy("project").agg(
        (F.count_if(alone) / F.count("*")).alias("alone"), _sorted(alone, "table").alias("alone_names"), F.sum(F.when(fact, c("calculated_columns"))).alias("calculated"), _sorted(fact, "table").alias("fact_names"),
        F.count_if(low).alias("low"), _sorted(low, "table").alias("low_names"),
    )
    typed = columns.where("data_type = 'string'").select("project", c("table").alias("t"), c("name").alias("c"))
    ends = edges.select("project", F.explode(F.array(F.struct(c("from_table").alias("t"), c("from_column").alias("c")), F.struct(c("to_table").alias("t"), c("to_column").alias("c")))).alias("e")).select("project", "e.*")
    keys = ends.join(typed, ["project", "t", "c"], "left_semi").groupBy("project").agg(F.countDistinct("t").alias("n"), F.array_sort(F.collect_set("t")).alias("names"))
    return _union([
        _findings(
            t, "MODEL",
            ("no_relationships", _flag((c("n_tables") > 1) & (c("n_edges") == 0)), None),
            ("no_fact_table", _flag((c("n_edges") > 0) & (c("n_facts") == 0)), None),
            ("multiple_facts_no_shared_dims", _flag((c("n_facts") >= 2) & (c("shared") == 0)), None),
            ("clean_dimensional_model", _flag((c("n_facts") > 0) & (c("n_dimensions") > 0) & (c("n_edges") > 0)), None),
            ("bridge_tables_present", c("bridge_tables"), None),
            ("high_classification_confidence", _flag(c("average_confidence") >= limits["high_classification_confidence"]), None),
        ),
        _findings(links, "MODEL", ("many_to_many", c("many"), c("many_names")), ("bidirectional", c("both"), c("both_names")), ("inactive_relationships", c("off"), c("off_names"))),
        _findings(own, "MODEL", ("isolated_tables", c("alone"), c("alone_names")), ("calculated_columns_in_facts", c("calculated"), c("fact_names")), ("low_confidence_classification", c("low"), c("low_names"))),
        _findings(keys, "MODEL", ("string_keys", c("n"), c("names"))),
    ])


def dax_findings(measures: DataFrame, literal: bool = False, names: R.RuleSet | None = None) -> DataFrame:
    """Findings about measures (name, table, expression, line_breaks, format_string)."""
    names = names or R.RuleSet()
    limits, e = names.limits, F.col("expression")
    m = measures.withColumn("complex", F.coalesce((F.col("line_breaks") >= limits["complex_measure_min_lines"]) | (dax.paren_depth(e) > limits["max_measure_nesting_depth"]), F.lit(False))).withColumn("has_var", F.coalesce(dax.var_count(e) > 0, F.lit(False)))
    m = m.withColumn("outside", ~F.col("table").isin(*names.measure_tables))
    c = F.col
    bare = F.lit(not literal) & c("format_string").isNull()
    whole, hidden, nested = dax.filters_whole_table(e), c("complex") & ~c("has_var"), dax.nests_iterators(e)
    wide = m.groupBy("project").agg(
        F.count("*").alias("total"), F.count_if("outside").alias("out"), _sorted(c("outside"), "name").alias("out_names"), F.count_if("complex").alias("complex"), F.count_if(c("complex") & c("has_var")).alias("with_var"),
        F.count_if(whole).alias("whole"), _sorted(whole, "name").alias("whole_names"), F.count_if(hidden).alias("hidden"), _sorted(hidden, "name").alias("hidden_names"),
        F.count_if(nested).alias("nested"), _sorted(nested, "name").alias("nested_names"), F.count_if(bare).alias("bare"), _sorted(bare, "name").alias("bare_names"),
    )
    return _findings(
        wide, "DAX",
        ("filter_over_full_table", c("whole"), c("whole_names")),
        ("no_var_in_complex_measure", c("hidden"), c("hidden_names")),
        ("nested_iterators", c("nested"), c("nested_names")),
        ("measure_without_format", c("bare"), c("bare_names")),
        ("measures_outside_dedicated_table", F.when(c("out") / c("total") > 0.10, c("out")).otherwise(0), F.slice("out_names", 1, 10)),
        ("all_measures_in_dedicated_table", _flag(c("out") == 0), None),
        ("var_usage_rate", _flag((c("complex") > 0) & (c("with_var") / F.greatest("complex", F.lit(1)) >= limits["var_usage_rate"])), None),
    )


def report_findings(pages: DataFrame, visuals: DataFrame, classes: DataFrame, warn: int = 8, critical: int = 12) -> DataFrame:
    """Findings about pages: each dense page is one."""
    shown = F.col("chart_count") + F.col("table_count") + F.col("card_count")
    most = K.dominant_visual(F.col("chart_count"), F.col("table_count"), F.col("card_count"))
    dense = pages.withColumn("shown", shown).where(F.col("shown") > warn)
    detail = F.concat(F.col("display_name"), F.lit(": "), F.col("shown").cast("string"), F.lit(" visuals, mostly "), F.lower(most))
    density = _finding(dense, "REPORT", "visuals_per_page", F.col("shown") - warn, F.array("display_name"), detail, F.when(F.col("shown") > critical, "CRITICAL").otherwise("WARNING"))
    hidden = pages.groupBy("project").agg(F.sum("hidden_count").alias("n"), _sorted(F.col("hidden_count") > 0, "display_name").alias("names"))
    slicers = visuals.where("category = 'SLICER'").select("project", "visual_id", F.explode_outer("all_fields").alias("f")).withColumn("t", F.regexp_extract("f", r"^'?([^'\[.]+)'?[\[.]", 1))
    facts = classes.where("classification = 'FACT'").select("project", F.col("table").alias("t"), F.lit(1).alias("on_fact"))
    clean = slicers.join(facts, ["project", "t"], "left").groupBy("project").agg(F.count("*").alias("n"), F.count("on_fact").alias("on_fact"))
    return _union([
        density,
        _finding(hidden, "REPORT", "hidden_visuals", F.col("n"), F.col("names")),
        _finding(clean.where("on_fact = 0"), "REPORT", "slicers_from_dimensions_only", F.lit(1)),
    ])


def governance_findings(projects: DataFrame, tables: DataFrame, measures: DataFrame, roles: DataFrame | None = None, names: R.RuleSet | None = None) -> DataFrame:
    """Findings about names, descriptions and roles; ``roles``: (project, role, is_dynamic), if known."""
    names = names or R.RuleSet()
    c = F.col
    forbidden, sensitive = c("table").isin(*names.forbidden), F.lower("table").rlike("|".join(names.sensitive))
    named = tables.groupBy("project").agg(F.count_if(forbidden).alias("bad"), _sorted(forbidden, "table").alias("bad_names"), F.count_if(sensitive).alias("sensitive"), _sorted(sensitive, "table").alias("sensitive_names"))
    bare = F.coalesce(F.trim("description"), F.lit("")) == ""
    described = measures.groupBy("project").agg(F.count("*").alias("total"), F.size(F.collect_set(F.when(bare, c("name")))).alias("bare"), _sorted(bare, "name").alias("names"))
    wide = projects.join(named, "project", "left").join(described, "project", "left")
    if roles is None:
        wide = wide.withColumn("static", F.lit(0)).withColumn("dynamic", F.lit(0))
    else:
        wide = wide.join(roles.groupBy("project").agg(F.count_if(~c("is_dynamic")).alias("static"), F.count_if("is_dynamic").alias("dynamic")), "project", "left")
    wide = wide.na.fill(0, ["bad", "sensitive", "total", "bare", "static", "dynamic"])
    return _findings(
        wide, "GOVERNANCE",
        ("naming_violations", c("bad"), c("bad_names")),
        ("no_description_on_measures", _flag((c("total") > 0) & (c("bare") / F.greatest("total", F.lit(1)) > names.limits["no_description_on_measures"])), F.slice("names", 1, 10)),
        ("no_rls_defined", _flag((c("sensitive") > 0) & (c("static") + c("dynamic") == 0)), c("sensitive_names")),
        ("static_rls_overuse", c("static") - names.limits["static_rls_overuse"], None),
        ("consistent_naming", _flag(c("bad") == 0), None),
        ("dynamic_rls_implemented", _flag(c("dynamic") > 0), None),
        ("documented_measures", _flag(c("bare") == 0), None),
    )


def issues(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with points (negative for a penalty), severity, code and recommendation; bonuses have no code.

    Codes number a project's issues within a dimension, in rule order. The
    isolation rule's points are rounded; caps hold for each finding.
    """
    f = findings.join(F.broadcast(rules), ["dimension", "rule"])
    raw = S.capped(F.col("n"), 1.0, 1e18) * F.col("per_unit")
    points = F.least(F.abs("most"), F.when(F.col("rule") == "isolated_tables", F.bround(raw, 0)).otherwise(raw))
    f = f.withColumn("points", F.when(F.col("most") > 0, -points).otherwise(points)).where("points <> 0")
    f = f.withColumn("severity", F.when(F.col("most") > 0, F.coalesce("severity_given", "severity")))
    order = Window.partitionBy("project", "dimension", F.col("most") > 0).orderBy("rule_no", F.coalesce("detail", F.lit("")))
    prefix = K.first_of([(F.col("dimension") == d, p) for d, p in R.PREFIXES.items()], "X")
    number = F.row_number().over(order)
    return f.withColumn("code", F.when(F.col("most") > 0, F.format_string("%s%03d", prefix, number))).select("project", "dimension", "rule_no", "rule", "code", "severity", "points", "affected", "detail", "recommendation")


def dimension_scores(projects: DataFrame, found: DataFrame, schema: DataFrame, names: R.RuleSet | None = None) -> DataFrame:
    """project, dimension, score, weight, weighted and counts of issues, for all four dimensions."""
    names = names or R.RuleSet()
    weights = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(float(w)).alias("weight")) for d, w in names.weights.items()))
    every = projects.select("project").distinct().select("project", F.explode(weights).alias("w")).select("project", "w.*")
    sums = found.groupBy("project", "dimension").agg(
        F.sum("points").alias("points"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), F.count_if(F.col("severity") == "INFO").alias("infos"),
    )
    ceiling = K.first_of([(F.col("schema_type") == k, v) for k, v in names.ceilings.items()], names.ceilings["UNKNOWN"])
    rows = every.join(sums, ["project", "dimension"], "left").join(schema.select("project", ceiling.alias("ceiling")), "project", "left").na.fill(0, ["points", "critical", "warnings", "infos"])
    score = S.clamp(F.least(F.lit(100) + F.col("points"), F.when(F.col("dimension") == "MODEL", F.coalesce("ceiling", F.lit(100))).otherwise(F.lit(1_000_000))))
    rows = rows.withColumn("score", score.cast("double"))
    return rows.withColumn("weighted", F.bround(F.col("score") * F.col("weight"), 2)).select("project", "dimension", "score", "weight", "weighted", "critical", "warnings", "infos")


def project_scores(dimensions: DataFrame, grades: dict[str, int] | None = None) -> DataFrame:
    out = dimensions.groupBy("project").agg(F.bround(F.sum(F.col("weighted").cast("decimal(12,4)")), 0).cast("int").alias("global_score"), F.sum("critical").alias("critical"), F.sum("warnings").alias("warnings"), F.sum("infos").alias("infos"))
    return out.withColumn("grade", K.grade(F.col("global_score"), grades or R.GRADES)).withColumn("status", K.status(F.col("global_score")))


def related_codes(found: DataFrame) -> DataFrame:
    """project, code, related: other codes of one severity that share an affected item."""
    items = found.where("code IS NOT NULL").select("project", "severity", "code", F.explode("affected").alias("item")).distinct()
    other = items.withColumnRenamed("code", "other")
    pairs = items.join(other, ["project", "severity", "item"]).where("code <> other")
    return pairs.groupBy("project", "code").agg(F.array_sort(F.collect_set("other")).alias("related"))


def next_steps(found: DataFrame) -> DataFrame:
    """project, severity, step_no, code, recommendation: the first 3 critical, 5 warnings and 5 infos."""
    order = Window.partitionBy("project", "severity").orderBy("rule_no", "code")
    rows = found.where("code IS NOT NULL").withColumn("step_no", F.row_number().over(order))
    return rows.where(F.col("step_no") <= F.when(F.col("severity") == "CRITICAL", 3).otherwise(5)).select("project", "severity", "step_no", "code", "recommendation")


def own_findings(relations: Mapping[str, DataFrame], names: R.RuleSet) -> list[DataFrame]:
    """Findings of the rules that the caller has registered."""
    return [_finding(find(relations), dimension, rule, F.col("n"), F.col("affected")) for dimension, rule, find in names.own]


def metadata(scores: DataFrame, schema: DataFrame, tables: DataFrame, columns: DataFrame, measures: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """project, grade, schema type and how many tables, columns, measures, relationships and pages were scored."""
    out = scores.select("project", "global_score", "grade").join(schema.select("project", "schema_type"), "project", "left")
    for name, rows in (("total_tables", tables), ("total_columns", columns), ("total_measures", measures), ("total_relationships", edges), ("total_pages", pages)):
        out = out.join(rows.groupBy("project").agg(F.count("*").alias(name)), "project", "left")
    return out.na.fill(0)
