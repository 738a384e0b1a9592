"""Lexical analysis of measure expressions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The functions that are recognised and what each weighs.
FUNCTIONS = {
    "SUM": 1, "COUNT": 1, "AVERAGE": 1, "MIN": 1, "MAX": 1, "COUNTA": 1, "COUNTBLANK": 1, "AND": 1, "OR": 1, "NOT": 1, "DIVIDE": 1,
    "DISTINCTCOUNT": 2, "ALL": 2, "ALLEXCEPT": 2, "ALLSELECTED": 2, "KEEPFILTERS": 2, "REMOVEFILTERS": 2, "RELATED": 2, "RELATEDTABLE": 2, "VALUES": 2, "DISTINCT": 2, "IF": 2, "IFERROR": 2,
    "SUMX": 3, "AVERAGEX": 3, "COUNTX": 3, "MAXX": 3, "MINX": 3, "CALCULATE": 3, "CALCULATETABLE": 3, "FILTER": 3, "USERELATIONSHIP": 3, "CROSSFILTER": 3, "TREATAS": 3,
    "TOTALYTD": 3, "TOTALQTD": 3, "TOTALMTD": 3, "SAMEPERIODLASTYEAR": 3, "PREVIOUSYEAR": 3, "PREVIOUSMONTH": 3, "DATEADD": 3, "DATESYTD": 3, "TOPN": 3, "SAMPLE": 3, "SELECTCOLUMNS": 3, "SWITCH": 3,
    "RANKX": 4, "PERCENTILEX.INC": 4, "PERCENTILEX.EXC": 4, "PARALLELPERIOD": 4, "ADDCOLUMNS": 4, "SUMMARIZE": 4,
}
#: Iterators, those that scores look at, and the patterns of findings.
ITERATORS = ("SUMX", "AVERAGEX", "MAXX", "MINX", "COUNTX", "PRODUCTX")
SCORED_ITERATORS = ("SUMX", "AVERAGEX", "MAXX", "MINX")
FILTER_OF_TABLE = r"FILTER\s*\(\s*'?[A-Z_][A-Z0-9_\s]*'?\s*,"
SCORED_FILTER_OF_TABLE = r"(?i)FILTER\s*\(\s*(?!VALUES\s*\()(?:'?[A-Za-z_][A-Za-z0-9_]*'?)\s*,"
IF_CALL, DIVISION = r"\bIF\s*\(", r"[^/<>=]\s*/\s*[^/<>=]"


def _called(expression: Column) -> Column:
    """The recognised functions of all calls, in order: one pass over the text, whatever their number. Two names have a dot in them."""
    names = F.regexp_extract_all(F.upper(expression), F.lit(r"\b(PERCENTILEX\.(?:INC|EXC)|[A-Z]++)\s*+\("), F.lit(1))
    return F.filter(names, lambda x: x.isin(*FUNCTIONS))


def functions_used(expression: Column) -> Column:
    """Recognised functions that are called, sorted by name."""
    return F.array_sort(F.array_distinct(_called(expression)))


def function_score(expression: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for kv in FUNCTIONS.items() for x in kv))
    return F.aggregate(_called(expression), F.lit(0), lambda total, name: total + F.element_at(weights, name))


def paren_depth(expression: Column) -> Column:
    """Deepest nesting of parentheses; an unmatched closing one does not go below zero."""
    marks = F.split(F.regexp_replace(expression, r"[^()]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = F.when(c == "(", a["now"] + 1).when(c == ")", F.greatest(a["now"] - 1, F.lit(0))).otherwise(a["now"])
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda a: a["most"])


def var_count(expression: Column) -> Column:
    return F.regexp_count(F.upper(expression), F.lit(r"\bVAR\b"))


def complexity(expression: Column) -> Column:
    """Weighted calls + half the nesting depth + 1.5 a VAR + log10 of the length, at most 3; null scores 0."""
    length = F.least(F.log10(F.greatest(F.length(expression), F.lit(1))), F.lit(3.0))
    total = function_score(expression) + paren_depth(expression) * 0.5 + var_count(expression) * 1.5 + length
    return F.coalesce(F.bround(total, 2), F.lit(0.0))


def is_stub(expression: Column) -> Column:
    return F.coalesce(F.length(F.trim(expression)) < 5, F.lit(True))


def bracketed(expression: Column) -> Column:
    """Every bracketed name, sorted and distinct."""
    found = F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(x))))


def measure_candidates(expression: Column, own: Column) -> Column:
    """Bracketed names not qualified by a table, without the measure itself."""
    found = F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"(?<![\w'])\[([^\]]+)\]"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(F.transform(found, lambda x: F.trim(x))), F.array(own)))


def _finding(when: Column, code: str, name: Column | str, severity: str, occurrences: Column | int, fix: str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(
        when,
        F.struct(F.lit(code).alias("code"), as_column(name).alias("name"), F.lit(severity).alias("severity"), as_column(occurrences).cast("int").alias("occurrences"), F.lit(fix).alias("fix")),
    )


def antipatterns(expression: Column) -> Column:
    """All findings DAX001 to DAX005 as (code, name, severity, occurrences, fix)."""
    e = F.coalesce(expression, F.lit(""))
    up = F.upper(e)
    filters = F.regexp_count(up, F.lit(FILTER_OF_TABLE))
    nested = [up.rlike(rf"{i}\s*\([^()]*{i}\s*\(") for i in ITERATORS]
    which = F.coalesce(*(F.when(c, F.lit(i)) for c, i in zip(nested, ITERATORS, strict=True)))
    complex_ = (F.length(e) > 200) | (F.regexp_count(e, F.lit(r"\(")) > 5)
    ifs = F.regexp_count(up, F.lit(IF_CALL))
    divisions = F.regexp_count(e, F.lit(DIVISION))
    found = F.array(
        _finding(filters > 0, "DAX001", "FILTER over full table", "HIGH", filters, "Filter one column: FILTER(VALUES(Table[Column]), ...) or CALCULATETABLE"),
        _finding(which.isNotNull(), "DAX002", F.concat(F.lit("Nested iterator: "), which), "HIGH", 1, "Compute the inner iterator in a VAR first"),
        _finding(complex_ & (var_count(e) == 0), "DAX003", "Complex measure without VAR", "MEDIUM", 1, "Name intermediate results with VAR"),
        _finding(ifs >= 3, "DAX004", F.concat(F.lit("Deep IF nesting: "), ifs.cast("string")), "MEDIUM", ifs, "Use SWITCH(TRUE(), ...)"),
        _finding((divisions > 0) & ~up.contains("DIVIDE"), "DAX005", "Division without DIVIDE", "LOW", divisions, "Use DIVIDE, which is safe for zero"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def highest_severity(findings: Column) -> Column:
    has = lambda s: F.exists(findings, lambda x: x["severity"] == s)
    return F.when(has("HIGH"), "HIGH").when(has("MEDIUM"), "MEDIUM").when(F.size(findings) > 0, "LOW").otherwise("NONE")


def filters_whole_table(expression: Column) -> Column:
    return F.coalesce(expression.rlike(SCORED_FILTER_OF_TABLE), F.lit(False))


def nests_iterators(expression: Column) -> Column:
    any_ = "(?:" + "|".join(SCORED_ITERATORS) + ")"
    return F.coalesce(F.upper(expression).rlike(rf"{any_}\s*\([^)]*{any_}\s*\("), F.lit(False))


def cleanup_risk(stub: Column, score: Column, base: Column) -> Column:
    return F.when(stub | (score == 0), "SAFE_DELETE").when(base, "DO_NOT_DELETE").when(score > 10, "INVESTIGATE").otherwise("REVIEW_SUGGESTED")


def role(base: Column, dependents: Column) -> Column:
    return F.when(base & (dependents >= 3), "FOUNDATION").when(base, "BASE").when(dependents == 0, "LEAF").otherwise("INTERMEDIATE")
