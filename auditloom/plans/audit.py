"""The whole audit over all projects: text and JSON in, relations out.

A relation is planned when it is first asked for, with those that it builds on.
What several others build on is written once, to a folder of the run; the rest
is lazy. ``close`` removes the folder when the results are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import blocks, extract, measures, model, scoring
from ..sources import rules, tmdl
from ..sources.shared import Run, dealt

_REPORT = "project string, page_id string, visual_id string, content string"


class Relations(Mapping):
    """Relations by name; each is planned once. ``Relations`` is a context manager: its end is ``close``.

    ``computed``: the text of the files is the result of a query; it is made and written once, not for each relation that reads it.
    """

    def __init__(self, files: DataFrame, report: DataFrame | None = None, roles: DataFrame | None = None, rules_path: str | rules.RuleSet | None = None, projects: DataFrame | None = None, computed: bool = False):
        self.spark, self.files, self.roles, self.projects = files.sparkSession, files, roles, projects
        self.report = self.spark.createDataFrame([], _REPORT) if report is None else report
        self.rules = rules_path if isinstance(rules_path, rules.RuleSet) else rules.read_rule_set(rules_path)
        self.computed = computed
        self.run = Run(self.spark, "audit")
        self._made: dict[str, DataFrame] = {}
        self._locks = {name: RLock() for name in _PLANS}

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._made:
                plan, needs, kept = _PLANS[name]
                self.prepare(*needs)
                df = plan(self)
                self._made[name] = self.run.settled(df, name) if kept else df
        return self._made[name]

    def prepare(self, *names: str) -> None:
        """Plan, and write, several relations at the same time."""
        open_ = [n for n in names if n not in self._made]
        if len(open_) < 2:
            for name in open_:
                self[name]
            return
        with ThreadPoolExecutor(len(open_)) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(self.__getitem__), open_))

    def __iter__(self) -> Iterator[str]:
        return (name for name in _PLANS if not name.startswith("_"))

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def close(self) -> None:
        self.run.close()

    def __enter__(self) -> Relations:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def own(self) -> DataFrame:
        """The files of tables that the product has not made itself."""
        return self["_files"].where(~K.is_internal_table(F.col("file_stem")))


#: name: (plan, what it builds on and is planned at the same time, whether it is written)
_PLANS: dict[str, tuple[Callable[[Relations], DataFrame], tuple[str, ...], bool]] = {}


def _relation(*needs: str, kept: bool = False) -> Callable:
    def add(plan: Callable[[Relations], DataFrame]) -> Callable:
        _PLANS[plan.__name__.removesuffix("_of")] = plan, needs, kept
        return plan

    return add


@_relation()
def _files(r: Relations) -> DataFrame:
    return r.run.settled(dealt(r.files, "project", "rel_path"), "files") if r.computed else r.files


@_relation("_files", kept=True)
def _objects(r: Relations) -> DataFrame:
    return blocks.dealt_objects(r.own, blocks.PARTS)


@_relation("_objects", kept=True)
def columns(r: Relations) -> DataFrame:
    return extract.columns(r["_objects"])


@_relation("_objects")
def partitions(r: Relations) -> DataFrame:
    return extract.partitions(r["_objects"])


@_relation("_objects", kept=True)
def relationships(r: Relations) -> DataFrame:
    return extract.relationships(r["_objects"])


@_relation("_objects", kept=True)
def _raw_measures(r: Relations) -> DataFrame:
    return extract.measures(r["_objects"])


@_relation("_raw_measures", "columns", kept=True)
def measure_edges(r: Relations) -> DataFrame:
    return measures.dependencies(r["_raw_measures"], r["columns"])


@_relation("_raw_measures", "measure_edges", kept=True)
def measures_of(r: Relations) -> DataFrame:
    return measures.graph(r["_raw_measures"], r["measure_edges"])


@_relation("_objects", "columns", "_raw_measures", kept=True)
def tables(r: Relations) -> DataFrame:
    return extract.tables(r.own, r["_objects"], r["columns"], r["_raw_measures"], r["partitions"])


@_relation("_files", kept=True)
def datasources(r: Relations) -> DataFrame:
    return extract.datasources(tmdl.source_files(r["_files"]))


@_relation("datasources")
def datasource_summary(r: Relations) -> DataFrame:
    return extract.datasource_summary(r["datasources"])


@_relation("datasources")
def datasource_counts(r: Relations) -> DataFrame:
    return extract.datasource_counts(r["datasources"])


@_relation(kept=True)
def visuals(r: Relations) -> DataFrame:
    return extract.visuals(r.report)


@_relation("visuals", kept=True)
def pages(r: Relations) -> DataFrame:
    return extract.pages(r.report, r["visuals"])


@_relation("pages")
def category_totals(r: Relations) -> DataFrame:
    return extract.category_totals(r["pages"])


@_relation("columns", "relationships", "tables")
def profiles(r: Relations) -> DataFrame:
    return model.profile(r["columns"], r["relationships"], r["tables"])


@_relation("profiles", kept=True)
def classifications(r: Relations) -> DataFrame:
    return model.classify(r["profiles"])


@_relation("classifications", "relationships")
def schema(r: Relations) -> DataFrame:
    return model.schema_type(r["classifications"], r["relationships"])


@_relation("classifications", "relationships")
def relationship_summary(r: Relations) -> DataFrame:
    return model.relationship_summary(r["classifications"], r["relationships"])


@_relation("measures", "measure_edges", "visuals", kept=True)
def unused_measures(r: Relations) -> DataFrame:
    return measures.unused(r["measures"], r["measure_edges"], r["visuals"])


@_relation("measures", "unused_measures")
def unused_summary(r: Relations) -> DataFrame:
    return measures.unused_summary(r["measures"], r["unused_measures"])


@_relation("columns", "measures", "visuals", kept=True)
def column_usage(r: Relations) -> DataFrame:
    return measures.column_usage(r["columns"], r["measures"], r["visuals"])


@_relation("column_usage")
def usage_summary(r: Relations) -> DataFrame:
    return measures.usage_summary(r["column_usage"])


@_relation("tables", "classifications", "relationships", "columns", "_raw_measures", "visuals", "pages", kept=True)
def issues(r: Relations) -> DataFrame:
    known = r["tables"].select("project", "table")
    found = [
        scoring.model_findings(r["classifications"], r["relationships"], r["columns"], r.rules),
        scoring.dax_findings(r["_raw_measures"], names=r.rules),
        scoring.report_findings(r["pages"], r["visuals"], r["classifications"], int(r.rules.limits["warning_threshold"]), int(r.rules.limits["critical_threshold"])),
        scoring.governance_findings(known.select("project").distinct(), known, r["_raw_measures"], r.roles, names=r.rules),
        *scoring.own_findings(r, r.rules),
    ]
    return scoring.issues(reduce(lambda a, b: a.unionByName(b), found), r.rules.frame(r.spark))


@_relation("tables", "issues", "classifications", "relationships")
def dimension_scores(r: Relations) -> DataFrame:
    return scoring.dimension_scores(r["tables"].select("project").distinct(), r["issues"], r["schema"], r.rules)


@_relation("dimension_scores")
def project_scores(r: Relations) -> DataFrame:
    return scoring.project_scores(r["dimension_scores"], r.rules.grades)


@_relation("classifications", "project_scores", "measures", "pages")
def score_metadata(r: Relations) -> DataFrame:
    return scoring.metadata(r["project_scores"], r["schema"], r["tables"], r["columns"], r["measures"], r["relationships"], r["pages"])


@_relation("tables")
def skipped_projects(r: Relations) -> DataFrame:
    """Projects that were found but have no definition file; none if the places were not searched."""
    found = r.spark.createDataFrame([], "project string") if r.projects is None else r.projects
    return tmdl.skipped_projects(found, r["_files"])


def relations(files: DataFrame, report: DataFrame | None = None, roles: DataFrame | None = None, rules_path: str | None = None, computed: bool = False) -> Relations:
    """All relations of the audit from definition files and, if there, report files."""
    return Relations(files, report, roles, rules_path, computed=computed)


def analyze(spark: SparkSession, root: str, rules_path: str | None = None) -> Relations:
    """All relations of all projects under ``root``."""
    return Relations(tmdl.read_tmdl(spark, root), tmdl.read_report(spark, root), tmdl.read_roles(spark, root), rules_path, tmdl.found_projects(spark, root))
