"""The rule table: one row for each scoring rule, broadcast to all projects."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Weights of the dimensions.
WEIGHTS = {"MODEL": 0.35, "DAX": 0.25, "REPORT": 0.25, "GOVERNANCE": 0.15}
#: The prefix of a dimension's issue codes.
PREFIXES = {"MODEL": "M", "DAX": "D", "REPORT": "R", "GOVERNANCE": "G"}
#: The most a schema type can score.
CEILINGS = {"STAR": 100, "GALAXY": 95, "SNOWFLAKE": 90, "DIMENSIONAL": 85, "UNKNOWN": 80, "FLAT": 70, "DISCONNECTED": 60}
#: Dimension, rule, points a unit (or at once), most points (negative: a bonus), severity; in order of evaluation.
RULES = (
    ("MODEL", "no_relationships", 35.0, 35.0, "CRITICAL", "Connect fact and dimension tables."),
    ("MODEL", "isolated_tables", 30.0, 25.0, "WARNING", "Connect isolated tables or remove them."),
    ("MODEL", "no_fact_table", 20.0, 20.0, "CRITICAL", "Provide at least one fact table."),
    ("MODEL", "multiple_facts_no_shared_dims", 10.0, 10.0, "INFO", "Let facts share dimensions."),
    ("MODEL", "many_to_many", 5.0, 15.0, "WARNING", "Resolve many-to-many relationships by bridges."),
    ("MODEL", "bidirectional", 3.0, 10.0, "INFO", "Filter in one direction where possible."),
    ("MODEL", "inactive_relationships", 2.0, 8.0, "INFO", "Document or remove inactive relationships."),
    ("MODEL", "string_keys", 3.0, 15.0, "WARNING", "Use integer keys in relationships."),
    ("MODEL", "calculated_columns_in_facts", 2.0, 10.0, "WARNING", "Move calculations out of fact tables."),
    ("MODEL", "low_confidence_classification", 2.0, 10.0, "INFO", "Name and connect tables so that their role is clear."),
    ("MODEL", "clean_dimensional_model", 5.0, -5.0, None, None),
    ("MODEL", "bridge_tables_present", 2.0, -5.0, None, None),
    ("MODEL", "high_classification_confidence", 5.0, -5.0, None, None),
    ("DAX", "filter_over_full_table", 8.0, 20.0, "WARNING", "Filter columns, not tables."),
    ("DAX", "no_var_in_complex_measure", 5.0, 15.0, "WARNING", "Name intermediate results with VAR."),
    ("DAX", "nested_iterators", 6.0, 12.0, "WARNING", "Do not nest iterators."),
    ("DAX", "measure_without_format", 2.0, 10.0, "INFO", "Give measures a format."),
    ("DAX", "measures_outside_dedicated_table", 3.0, 10.0, "INFO", "Keep measures in one table."),
    ("DAX", "all_measures_in_dedicated_table", 8.0, -8.0, None, None),
    ("DAX", "var_usage_rate", 5.0, -5.0, None, None),
    ("REPORT", "visuals_per_page", 2.0, 15.0, "WARNING", "Show less on a page."),
    ("REPORT", "hidden_visuals", 3.0, 9.0, "INFO", "Remove hidden visuals."),
    ("REPORT", "slicers_from_dimensions_only", 5.0, -5.0, None, None),
    ("GOVERNANCE", "naming_violations", 2.0, 10.0, "INFO", "Rename tables that have default names."),
    ("GOVERNANCE", "no_description_on_measures", 8.0, 8.0, "WARNING", "Describe measures."),
    ("GOVERNANCE", "no_rls_defined", 20.0, 20.0, "CRITICAL", "Define row-level security for sensitive tables."),
    ("GOVERNANCE", "static_rls_overuse", 3.0, 12.0, "INFO", "Prefer dynamic roles."),
    ("GOVERNANCE", "consistent_naming", 8.0, -8.0, None, None),
    ("GOVERNANCE", "dynamic_rls_implemented", 10.0, -10.0, None, None),
    ("GOVERNANCE", "documented_measures", 5.0, -5.0, None, None),
)
#: Names that say nothing, words that point to sensitive data, tables for measures.
FORBIDDEN_NAMES = ("Table", "Sheet1", "Query1", "data", "Data")
SENSITIVE = ("salary", "ssn", "email", "password", "credit", "financial")
MEASURE_TABLES = ("_Measures", "Calculations", "_Calculations")


#: Grades by the least score that gets them, and the limits that rules compare with.
GRADES = {"A": 85, "B": 75, "C": 60, "D": 45, "F": 0}
LIMITS = {
    "complex_measure_min_lines": 5, "max_measure_nesting_depth": 4, "warning_threshold": 8, "critical_threshold": 12,
    "low_confidence_classification": 0.60, "high_classification_confidence": 0.85, "var_usage_rate": 0.70, "no_description_on_measures": 0.50, "static_rls_overuse": 5,
}
#: What a rule file calls the dimensions' weights, and the points of one unit or at once.
FILE_WEIGHTS = {"model_health": "MODEL", "dax_quality": "DAX", "report_design": "REPORT", "governance": "GOVERNANCE"}
FILE_UNITS = ("per_table_ratio", "per_relationship", "per_table", "per_column", "per_measure", "per_visual", "per_visual_over_warning", "per_role_over_threshold", "value")
_COLUMNS = ("dimension", "rule", "rule_no", "per_unit", "most", "severity", "recommendation")
_SCHEMA = "dimension string, rule string, rule_no int, per_unit double, most double, severity string, recommendation string"


@dataclass
class RuleSet:
    """Rules, weights, ceilings and limits of one run. ``add`` registers a caller's own rule."""

    rows: dict[tuple[str, str], list] = field(default_factory=lambda: {(d, r): [d, r, i, per, most, severity, text] for i, (d, r, per, most, severity, text) in enumerate(RULES)})
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    ceilings: dict[str, int] = field(default_factory=lambda: dict(CEILINGS))
    grades: dict[str, int] = field(default_factory=lambda: dict(GRADES))
    limits: dict[str, float] = field(default_factory=lambda: dict(LIMITS))
    forbidden: tuple[str, ...] = FORBIDDEN_NAMES
    sensitive: tuple[str, ...] = SENSITIVE
    measure_tables: tuple[str, ...] = MEASURE_TABLES
    #: Rules that a file names and that are not evaluated.
    unscored: list[str] = field(default_factory=list)
    own: list[tuple[str, str, Callable[[Mapping[str, DataFrame]], DataFrame]]] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows.values()], _SCHEMA)

    def add(self, dimension: str, rule: str, per_unit: float, most: float, severity: str | None, recommendation: str | None, find: Callable[[Mapping[str, DataFrame]], DataFrame]) -> None:
        """A rule of the caller: ``find`` gets the relations and returns (project, n, affected) with n findings each; ``most`` below zero is a bonus."""
        if dimension not in self.weights:
            raise ValueError(f"unknown dimension: {dimension}")
        if (dimension, rule) in self.rows:
            raise ValueError(f"there is a rule {dimension}.{rule}")
        self.rows[dimension, rule] = [dimension, rule, len(self.rows), float(per_unit), float(most), severity, recommendation]
        self.own.append((dimension, rule, find))

    def _points(self, dimension: str, rule: str, given: dict, bonus: bool) -> None:
        """One rule of a file's penalties or bonuses."""
        row = self.rows.get((dimension, rule))
        if row is None:
            self.unscored.append(f"{dimension}.{rule}")
            return
        units = [float(given[k]) for k in FILE_UNITS if k in given]
        if units:
            row[3] = units[0]
            row[4] = float(given.get("max", units[0])) * (-1 if bonus else 1)
        for key in ("threshold", "ratio_threshold"):
            if key in given and rule in self.limits:
                self.limits[rule] = float(given[key])
        self.limits |= {k: float(given[k]) for k in ("warning_threshold", "critical_threshold") if k in given}

    def read(self, path: str) -> RuleSet:
        """Take over a YAML rule file: ``scoring`` with weights, and penalties, bonuses, ceilings, limits and names by dimension; or changes by dimension and rule."""
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f)
        if not given or "scoring" not in given:
            raise ValueError("the rule file has no scoring section")
        self.grades |= given["scoring"].get("grade_thresholds") or {}
        for section, content in given["scoring"].items():
            if section == "weights":
                self.weights |= {FILE_WEIGHTS[k]: float(v) for k, v in content.items()}
            elif section not in ("grade_thresholds", "metadata"):
                self._dimension(section.upper(), content)
        return self

    def _dimension(self, dimension: str, content: dict) -> None:
        if dimension not in self.weights:
            raise ValueError(f"unknown dimension: {dimension}")
        for rule, change in content.items():
            if rule in ("penalties", "bonuses"):
                for name, given in (change or {}).items():
                    self._points(dimension, name, given or {}, rule == "bonuses")
            elif rule == "schema_ceilings":
                self.ceilings |= change
            elif rule == "thresholds":
                self.limits |= {k: float(v) for k, v in change.items() if k in self.limits}
            elif rule == "naming_conventions":
                self.forbidden = tuple(change.get("forbidden_names", self.forbidden))
            else:
                row = self.rows.get((dimension, rule))
                if row is None:
                    raise ValueError(f"unknown rule: {dimension.lower()}.{rule}")
                for key, value in change.items():
                    row[_COLUMNS.index(key)] = float(value) if key in ("per_unit", "most") else value


def read_rule_set(path: str | None = None) -> RuleSet:
    return RuleSet().read(path) if path else RuleSet()


def read_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """dimension, rule, rule_no, per_unit, most, severity, recommendation."""
    return read_rule_set(path).frame(spark)
