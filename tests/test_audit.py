"""The audit on text fixtures: blocks, columns, references, expressions, graph, classes, scores, sinks."""

import os
import random
from pathlib import Path

import model_projects
import pytest
from pyspark.sql import functions as F

from auditloom.functions import classify as K
from auditloom.functions import dax
from auditloom.functions import text as S
from auditloom.functions.register import register_functions
from auditloom.operators import blocks, extract, measures, model, rings, scoring
from auditloom.plans import audit, charts, documents, prompts
from auditloom.sources import model_files, rules, sinks, tmdl


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_blocks_end_at_the_next_object():
    text = "table T\n\tcolumn A\n\t\tdataType: x\n\n\t\tannotation N = V\n    measure M = 1\n\tcolumn B\n"
    assert list(blocks.split_blocks(text, "column")) == [("A", "\t\tdataType: x\n\n\t\tannotation N = V", 2), ("B", "", 7)]
    assert list(blocks.split_blocks(text, "measure")) == [("M = 1", "", 6)]
    assert list(blocks.split_blocks("", "table")) == []
    assert blocks.indent("\t  x") == 6 and not blocks.starts_object("columns x") and blocks.starts_object("level x")


@pytest.mark.parametrize(("header", "block", "want"), [
    ("M = SUM(x)", "\tformatString: 0", "SUM(x)"),
    ("M =", "\t\tVAR a = 1\n\t\tRETURN a\n\tformatString: 0", "VAR a = 1\n\t\tRETURN a"),
    ("M = ```", "\t\tSUM(y)\n\t\t```\n\tlineageTag: 1", "\n\t\tSUM(y)\n\t\t"),
    ("M", "\tformatString: 0", None),
    ("M =", "", None),
])
def test_measure_bodies(header, block, want):
    assert blocks.measure_body(header, block) == want


def test_sql_functions_and_table_function(spark):
    register_functions(spark)
    assert spark.sql("SELECT text_preview(' a  b ', 300) AS x, score_grade(75D) AS g, capped_points(9D, 2D, 15D) AS p").first() == ("a b", "B", 15.0)
    rows = spark.sql("SELECT t.header, t.line FROM VALUES ('column A\ncolumn B') v(c), LATERAL tmdl_blocks(v.c, 'column') t").collect()
    assert [tuple(r) for r in rows] == [("A", 1), ("B", 2)]


@pytest.mark.parametrize(("text", "table", "column"), [("T[C d]", "T", "C d"), ("'My T'.'C'", "My T", "C"), ("a.b.C", "a.b", "C"), ("'T x'[C]", "T x", "C"), ("nothing", None, None)])
def test_references(spark, text, table, column):
    assert one(spark, S.reference_table(F.col("v")), v=text) == table
    if table:
        assert one(spark, S.reference_column(F.col("v")), v=text) == column


@pytest.mark.parametrize(("expression", "score", "depth"), [("SUM(a)", 1 + 0.5 + 0.78, 1), ("f(((", 1.5 + 0.6, 3), ("a))((b)", 1.0 + 0.85, 2), (None, 0.0, None), ("VAR x = 1", 1.5 + 0.95, 0)])
def test_complexity(spark, expression, score, depth):
    assert one(spark, dax.complexity(F.col("v")), v=expression) == pytest.approx(score, abs=0.011)
    assert one(spark, dax.paren_depth(F.col("v")), v=expression) == depth


@pytest.mark.parametrize(("expression", "codes"), [
    ("CALCULATE(FILTER(Sales, x))", ["DAX001"]), ("FILTER(VALUES(a), x)", []), ("SUMX(a, SUMX(b, c))", ["DAX002"]), ("f(" * 6, ["DAX003"]), ("VAR q = " + "f(" * 6, []),
    ("IF(a, IF(b, 1))", []), ("IF(a, IF(b, IF(c, 1)))", ["DAX004"]), ("a / b", ["DAX005"]), ("DIVIDE(a, b) + c / d", []), (None, []),
])
def test_antipatterns(spark, expression, codes):
    assert [x["code"] for x in one(spark, dax.antipatterns(F.col("v")), v=expression)] == codes


@pytest.mark.parametrize(("block", "kind"), [("x = DATATABLE()", "DATATABLE"), ("Sql.Database csv", "SQL"), ("Excel.Workbook", "Excel"), ("a.csv", "CSV/Text"), ("SharePoint.Files", "SharePoint"), ("http://x", "Web"), ("let x in y", "Power Query"), ("?", "Unknown")])
def test_partition_sources(spark, block, kind):
    assert one(spark, K.partition_source(F.col("v")), v=block) == kind


def test_confidence_and_grades(spark):
    rows = spark.createDataFrame([(140, 140), (20, 20), (10, 10), (60, 80), (-5, -5)], "b int, t int").select(K.confidence(F.col("b"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [0.95, 0.75, 0.68, 0.78, 0.3]
    grades = spark.createDataFrame([(x,) for x in (85, 84, 75, 74, 60, 59, 45, 44)], "s int").select(K.grade(F.col("s"))).collect()
    assert "".join(r[0] for r in grades) == "ABBCCDDF"


def _typed(spark, classes, edges):
    c = spark.createDataFrame([("p", t, k) for t, k in classes], "project string, table string, classification string")
    e = spark.createDataFrame([("p", a, b) for a, b in edges], "project string, from_table string, to_table string")
    return model.schema_type(c, e).first()["schema_type"]


@pytest.mark.parametrize(("classes", "edges", "kind"), [
    ("F", "", "FLAT"), ("FDD", "", "DISCONNECTED"), ("FFD", "02 12", "GALAXY"), ("FDD", "01 12", "SNOWFLAKE"), ("FDD", "01 02", "STAR"), ("DD", "01", "DIMENSIONAL"), ("FD", "01", "UNKNOWN"),
])
def test_schema_types(spark, classes, edges, kind):
    names = {"F": "FACT", "D": "DIMENSION"}
    assert _typed(spark, [(str(i), names[c]) for i, c in enumerate(classes)], [tuple(e) for e in edges.split()]) == kind


def test_components_ignore_unknown_tables(spark):
    t = spark.createDataFrame([("p", x) for x in "abcdefg"], "project string, table string")
    e = spark.createDataFrame([("p", *x) for x in ("ab", "bc", "cd", "ef", "gz", "zf")], "project string, from_table string, to_table string")
    got = {r["table"]: r["component"] for r in model.components(t, e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}


def test_report_density_boundaries(spark):
    pages = spark.createDataFrame([("p", str(n), f"page{n:02d}", n, 0, 0, 0) for n in (8, 9, 12, 13, 30)], "project string, page_id string, display_name string, chart_count int, table_count int, card_count int, hidden_count int")
    visuals = spark.createDataFrame([], "project string, visual_id string, category string, all_fields array<string>")
    classes = spark.createDataFrame([], "project string, table string, classification string")
    got = scoring.issues(scoring.report_findings(pages, visuals, classes), rules.read_rules(spark)).orderBy("code").collect()
    assert [(r["affected"][0], r["severity"], r["points"]) for r in got] == [("page09", "WARNING", -2.0), ("page12", "WARNING", -8.0), ("page13", "CRITICAL", -10.0), ("page30", "CRITICAL", -15.0)]
    assert [r["code"] for r in got] == ["R001", "R002", "R003", "R004"]


def test_governance_boundaries(spark):
    projects = spark.createDataFrame([("a",), ("b",), ("c",)], "project string")
    tables = spark.createDataFrame([("a", "Sheet1"), ("b", "salary_2020"), ("c", "x")], "project string, table string")
    m = spark.createDataFrame([("a", "m1", None), ("a", "m2", "d"), ("b", "m1", " "), ("b", "m2", None), ("b", "m3", "d")], "project string, name string, description string")
    got = {(r["project"], r["rule"]): r["n"] for r in scoring.governance_findings(projects, tables, m).collect()}
    assert ("a", "naming_violations") in got and ("a", "consistent_naming") not in got and ("b", "consistent_naming") in got
    assert ("a", "no_description_on_measures") not in got and ("b", "no_description_on_measures") in got
    assert ("b", "no_rls_defined") in got and ("a", "no_rls_defined") not in got and ("c", "documented_measures") in got


def test_projects_at_any_depth(spark, tmp_path):
    """Files with a leading underscore are read wherever they lie, and where only Spark knows the store; empty projects are named."""
    deep = tmp_path / "a/b/c/d/e/f/g/Über.SemanticModel/definition/tables"
    deep.mkdir(parents=True)
    (deep / "_Measures.tmdl").write_text("table _Measures\n\tmeasure A = 1 + 1\n")
    (deep / "sales.tmdl").write_text("table sales\n\tcolumn B\n")
    (deep.parent / "roles").mkdir()
    (deep.parent / "roles" / "own.tmdl").write_text("role own\n\ttablePermission sales = [B] = USERPRINCIPALNAME()\n")
    (tmp_path / "x/Empty.SemanticModel/definition").mkdir(parents=True)
    files = tmdl.read_tmdl(spark, str(tmp_path))
    assert {(r["project"], r["rel_path"]) for r in files.collect()} == {("Über", "tables/_Measures.tmdl"), ("Über", "tables/sales.tmdl"), ("Über", "roles/own.tmdl")}
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(str(deep / "_Measures.tmdl"))
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    (row,) = tmdl._copied(spark, store, [place]).collect()
    assert row["path"].endswith("_Measures.tmdl") and bytes(row["content"]).startswith(b"table _Measures")
    with audit.analyze(spark, str(tmp_path)) as r:
        assert [x["project"] for x in r["skipped_projects"].collect()] == ["Empty"]
        assert r["measures"].count() == 1
        assert r["issues"].where("rule = 'dynamic_rls_implemented'").count() == 1
    assert not os.path.exists(r.run.root.removeprefix("file:"))


def test_command_line(spark, project, tmp_path, capsys):
    from auditloom.__main__ import main

    assert main([project, "--out", str(tmp_path / "o")]) == 0
    said = capsys.readouterr().out
    assert "shop: 92 A" in said and "1 projects, 0 skipped" in said
    assert spark.read.json(str(tmp_path / "o/data/columns")).count() == 19 and spark.read.json(str(tmp_path / "o/documents")).count() == 3


def test_lists_and_wrapped_lists(spark, tmp_path):
    for name, text in (("a", '[{"x": 1}, {"x": 2}]'), ("b", '{"rows": [{"x": 3}]}'), ("c", "{bad"), ("d", '{"other": 1}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r["x"] for r in sinks.as_list(spark, str(tmp_path), "rows", "x int").collect()) == [1, 2, 3]


def test_rule_file_with_penalties_and_bonuses(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("""
scoring:
  weights: {model_health: 0.4, dax_quality: 0.2, report_design: 0.2, governance: 0.2}
  model:
    penalties:
      many_to_many: {per_relationship: 7, max: 21, label: x}
      isolated_tables: {per_table_ratio: 40, max: 30}
      no_fact_table: {condition: y, value: 11}
    bonuses:
      bridge_tables_present: {per_table: 1, max: 3}
      high_classification_confidence: {threshold: 0.5, value: 6}
    schema_ceilings: {STAR: 50, GALAXY: 50, SNOWFLAKE: 50}
  dax:
    penalties:
      duplicate_logic: {per_pair: 4, max: 12}
    thresholds: {complex_measure_min_lines: 2}
  report:
    penalties:
      visuals_per_page: {warning_threshold: 20, critical_threshold: 30, per_visual_over_warning: 2, max: 15}
  governance:
    naming_conventions: {forbidden_names: [calendar]}
""")
    pytest.importorskip("yaml")
    names = rules.read_rule_set(str(path))
    rows = {r["rule"]: (r["per_unit"], r["most"]) for r in names.frame(spark).collect()}
    assert rows["many_to_many"] == (7, 21) and rows["isolated_tables"] == (40, 30) and rows["no_fact_table"] == (11, 11)
    assert rows["bridge_tables_present"] == (1, -3) and rows["high_classification_confidence"] == (6, -6)
    assert names.unscored == ["DAX.duplicate_logic"] and names.weights["MODEL"] == 0.4 and names.ceilings["STAR"] == 50 and names.limits["complex_measure_min_lines"] == 2

    def wide(r):
        found = r["tables"].where("column_count >= 9").groupBy("project").agg(F.count("*").alias("n"), F.collect_list("table").alias("affected"))
        return found

    names.add("GOVERNANCE", "wide_tables", 3, 9, "INFO", "Split wide tables.", wide)
    with pytest.raises(ValueError, match="there is a rule"):
        names.add("GOVERNANCE", "wide_tables", 3, 9, "INFO", None, wide)
    r = audit.relations(model_projects.files(spark, "shop"), model_projects.report(spark, "shop"), rules_path=names)
    got = {x["rule"]: x for x in r["issues"].collect()}
    assert got["wide_tables"]["points"] == -3 and got["wide_tables"]["affected"] == ["sales"]
    assert got["many_to_many"]["points"] == -7 and "visuals_per_page" not in got and got["naming_violations"]["affected"] == ["calendar"]
    assert r["dimension_scores"].where("dimension = 'MODEL'").first()["score"] <= 50


def test_rule_files(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("scoring:\n  dax:\n    nested_iterators: {per_unit: 1, most: 2}\n")
    pytest.importorskip("yaml")
    row = rules.read_rules(spark, str(path)).where("rule = 'nested_iterators'").first()
    assert (row["per_unit"], row["most"]) == (1.0, 2.0)
    path.write_text("other: 1\n")
    with pytest.raises(ValueError, match="scoring"):
        rules.read_rules(spark, str(path))


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    for path, text in model_projects.FILES.items():
        target = root / "shop.SemanticModel/definition" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode() + (b"\xff" if path == "expressions.tmdl" else b""))
    for page, visual, text in model_projects.REPORT:
        name = f"{page}/visuals/{visual}/visual.json" if visual else f"{page}/page.json" if page else "pages.json"
        target = root / "shop.Report/definition/pages" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return str(root)


def test_projects_on_disk(spark, project, tmp_path):
    files, report = tmdl.read_tmdl(spark, project), tmdl.read_report(spark, project)
    assert {r["rel_path"]: r["content"] for r in files.collect()} == model_projects.FILES
    assert {(r["page_id"], r["visual_id"]) for r in report.collect()} == {(p, v) for p, v, _ in model_projects.REPORT}
    assert {r["project"] for r in files.collect()} == {r["project"] for r in report.collect()} == {"shop"}
    r = audit.analyze(spark, project)
    assert len(r) == len(list(r)) and "_objects" not in list(r)
    assert r["project_scores"].first()["grade"] == "A" and r["skipped_projects"].count() == 0
    usage = r["usage_summary"].first()
    assert usage["total_columns"] == usage["used_columns"] + usage["total_unused"]
    assert sum(x["share"] for x in charts.class_shares(r["classifications"]).collect()) == pytest.approx(100, abs=0.3)
    nodes, edges = charts.relationship_graph(r["tables"], r["relationships"])
    assert nodes.count() == 6 and edges.count() == 3
    assert charts.measure_graph_statistics(r["measures"], r["measure_edges"]).first()["edges"] == 11
    written = sinks.write_documents(documents.all_documents(r), str(tmp_path / "out"))
    place = Path(written.where("document = 'compliance'").first()["path"])
    (part,) = place.glob("part-*")
    assert part.read_text().startswith("# Compliance: shop\nScore 92, grade A") and written.count() == 3
    some = {name: r[name] for name in ("columns", "issues", "project_scores", "datasource_counts", "relationship_summary", "score_metadata")}
    sinks.write_relations(some, str(tmp_path / "rel"))
    again = sinks.read_relations(spark, str(tmp_path / "rel"), {**some, "pages": r["pages"]})
    for name, df in some.items():
        assert sorted(map(str, again[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    assert again["pages"].count() == 0 and set(sinks.read_relations(spark, str(tmp_path / "rel"))) == set(some)
    meta = r["score_metadata"].first()
    assert (meta["total_tables"], meta["total_measures"], meta["total_relationships"], meta["total_pages"]) == (6, 12, 4, 2)
    answers = prompts.complete(prompts.prompts(r), lambda p: p.split()[0]).collect()
    assert {a["answer"] for a in answers} == {"Describe"} and len(answers) == 4
    assert prompts.token_usage(r["measures"]).where("token = 'IF'").first()["n"] == 1


def test_watched_folder(spark, project, tmp_path):
    from auditloom.streaming.watch import watch

    def run():
        watch(spark, project, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(300)
        return sorted(p.name for p in (tmp_path / "out").iterdir())

    assert run() == ["batch=0"]
    assert spark.read.json(str(tmp_path / "out/batch=0/project_scores")).count() == 1
    assert run() == ["batch=0"]  # nothing has changed
    (place,) = Path(project).rglob("_Measures.tmdl")
    place.write_text(place.read_text().replace("measure Stub = 1", "measure Stub = 2 + [Band]"))
    (first, second) = run()
    assert spark.read.json(str(tmp_path / f"out/{second}/measures")).where("name = 'Stub'").first()["expression"] == "2 + [Band]"


def test_many_folders_are_listed_in_slots(spark, tmp_path):
    """10,000 project folders: each file is found by one slot, files in other places are not opened (a pipe would never end)."""
    for i in range(10_000):
        folder = tmp_path / f"m{i:05d}.SemanticModel/definition"
        folder.mkdir(parents=True)
        (folder / "_own.tmdl").write_text(f"table t{i}\n")
    page = tmp_path / "deep/er/R.Report/definition/pages/p1"
    page.mkdir(parents=True)
    (page / "page.json").write_text('{"displayName": "P"}')
    for pipe in ("other.json", "m00000.SemanticModel/other.tmdl", "deep/er/R.Report/report.json"):
        os.mkfifo(tmp_path / pipe)
    slots = [list(model_files.walk(str(tmp_path), "definition", k, 16)) for k in range(16)]
    sizes = [len(x) for x in slots]
    assert sum(sizes) == 10_000 and max(sizes) < 2 * min(sizes) and len({r[0] for x in slots for r in x}) == 10_000
    files = tmdl.read_tmdl(spark, str(tmp_path))
    assert files.where("content = concat('table t', cast(substr(project, 2) as int), '\n') and file_stem = '_own'").count() == 10_000
    assert "model_files" in files._jdf.queryExecution().toString()
    assert [(r["project"], r["page_id"]) for r in tmdl.read_report(spark, str(tmp_path)).collect()] == [("R", "p1")]
    assert tmdl.found_projects(spark, str(tmp_path)).count() == 10_000
    one = model_files.listing(spark, str(tmp_path / "m00007.SemanticModel"), "definition", slots=3)
    assert [r["path"].rsplit("/", 1)[-1] for r in one.collect()] == ["_own.tmdl"]


def test_empty_projects(spark):
    nothing = model_projects.files(spark).limit(0)
    r = audit.relations(nothing)
    assert all(r[name].count() == 0 for name in ("columns", "measures", "classifications", "project_scores", "unused_summary"))


def test_longest_paths(spark):
    """Chains and ladders of any length; rings as they are walked one by one."""
    chain = {f"m{i}": {f"m{i + 1}"} for i in range(500)}
    assert rings.longest(chain)["m0"] == 500
    ladder = {f"{s}{i}": {f"a{i + 1}", f"b{i + 1}"} for i in range(40) for s in "ab"}
    assert rings.longest(ladder)["a0"] == 40
    assert rings.longest({"1": {"2"}, "2": {"3"}, "3": {"1"}}) == {"1": 3, "2": 3, "3": 3}

    def walked(edges, node, seen=frozenset()):
        if node in seen or not edges.get(node):
            return 0
        return 1 + max(walked(edges, d, seen | {node}) for d in edges[node])

    random.seed(3)
    for _ in range(300):
        n = random.randint(2, 7)
        edges = {}
        for a in range(n):
            for b in range(n):
                if a != b and random.random() < 0.25:
                    edges.setdefault(str(a), set()).add(str(b))
        assert rings.longest(edges) == {x: walked(edges, x) for x in edges}, edges
    ring = {str(i): {str((i + 1) % 30)} for i in range(30)}
    assert set(rings.longest(ring).values()) == {30}
    rows = [("p", a, b) for a, own in chain.items() for b in own] + [("q", a, b) for a, own in ladder.items() for b in own]
    got = {(r["project"], r["name"]): r["depth"] for r in measures.depths(spark.createDataFrame(rows, "project string, name string, dependency string")).collect()}
    assert got["p", "m0"] == 500 and got["q", "b0"] == 40


def test_rings_against_walks():
    """Rings of up to 20 members with and without chords, two rings that share a member; beyond the search there is no depth."""

    def walked(edges, node, seen=frozenset()):
        if node in seen or not edges.get(node):
            return 0
        return 1 + max(walked(edges, d, seen | {node}) for d in edges[node])

    random.seed(4)
    for n in range(13, 21):
        for chords in (0, 1, 4):
            edges = {str(i): {str((i + 1) % n)} for i in range(n)}
            for _ in range(chords):
                edges[str(random.randrange(n))].add(str(random.randrange(n)))
            edges["x"] = {"0", "1"}
            edges["3"].add("leaf")
            assert rings.longest(edges) == {x: walked(edges, x) for x in edges}, edges
    shared = {**{f"a{i}": {f"a{i + 1}"} for i in range(6)}, "a6": {"s"}, "s": {"a0", "b0"}, **{f"b{i}": {f"b{i + 1}"} for i in range(5)}, "b5": {"s"}}
    assert rings.longest(shared) == {x: walked(shared, x) for x in shared}
    assert rings.longest(shared)["s"] == 8
    assert set(rings.longest({str(i): {str((i + 1) % 1500)} for i in range(1500)}).values()) == {1500}
    dense = {str(i): {str(j) for j in range(30) if j != i} for i in range(30)} | {"up": {"3"}, "free": {"end"}}
    assert rings.longest(dense) == dict.fromkeys([*map(str, range(30)), "up"]) | {"free": 1}


def test_depths_without_one_group_a_project(spark):
    """A project beyond the bound is solved over all tasks, with the same depths: chains, rings, rings behind rings."""
    rows = [("p", a, b) for a, b in ("ab", "bc", "ca", "cd", "de", "ed", "xa", "ef", "yx", "gy", "fg", "hi", "ih", "ih", "dd", "zh")]
    rows += [("q", f"c{i}", f"c{i + 1}") for i in range(300)] + [("q", f"m{i}", f"m{i // 4}") for i in range(1, 500)] + [("q", "m7", "c0")]
    edges = {}
    for project, a, b in rows:
        edges.setdefault(project, {}).setdefault(a, set()).add(b)
    want = {(project, n): d for project, own in edges.items() for n, d in rings.longest(own).items()}
    df = spark.createDataFrame(rows, "project string, name string, dependency string")
    assert {(r["project"], r["name"]): r["depth"] for r in measures.depths(df, group=12).collect()} == want
    lost = {r["name"]: r["depth"] for r in measures.depths(df.where("project = 'p'"), group=2).collect()}
    assert lost["a"] is None and lost["y"] is None and lost["h"] == 2


def test_first_affected(spark):
    rows = spark.createDataFrame([("p", x) for x in ("d", "a", "c", "a", "b")] + [("q", "z"), (None, "y")], "project string, name string")
    assert {r["project"]: (r["first"], r["more"]) for r in scoring.first_affected(rows, "name").collect()} == {"p": (["a", "b", "c"], 1), "q": (["z"], 0), None: (["y"], 0)}


def test_graph_shapes(spark):
    rows = [("p", n, e) for n, e in (("a", "1"), ("b", "[a]"), ("c", "[a] + [b]"), ("d", "[c] + [b]"), ("self", "[self] + 1"), ("u", "[nowhere]"), ("col", "[X]"))]
    m = extract.analysed(spark.createDataFrame(rows, "project string, name string, expression string"))
    columns = spark.createDataFrame([("p", "X")], "project string, name string")
    edges = measures.dependencies(m, columns)
    got = {r["name"]: (r["dependency_depth"], r["dependents_count"]) for r in measures.graph(m, edges).collect()}
    assert got == {"a": (0, 2), "b": (1, 2), "c": (2, 1), "d": (3, 0), "self": (0, 0), "u": (0, 0), "col": (0, 0)}
