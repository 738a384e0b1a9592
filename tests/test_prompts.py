"""The lists of the prompts and the sections on unused measures and columns, against the relations they come from."""

import model_projects
import pytest
from pyspark.sql import functions as F

from auditloom.plans import audit, documents, prompts, queries


@pytest.fixture(scope="module")
def shop(spark):
    return audit.relations(model_projects.files(spark, "shop"), model_projects.report(spark, "shop"))


def texts(shop):
    return {p["block"]: p["prompt"].split("\n\n") for p in prompts.prompts(shop).collect()}


def listed(parts, title):
    (part,) = [p for p in parts if p.startswith(title + ":\n")]
    return part.split("\n")[1:]


def test_lists_of_prompts(shop):
    blocks = texts(shop)
    complex_ = sorted((m for m in shop["measures"].collect() if not m["is_stub"]), key=lambda m: (-m["complexity_score"], m["name"], m["table"]))[:5]
    got = listed(blocks["expressions"], "Most complex measures")
    assert [x.split(" (complexity ")[0] for x in got] == [f"- {m['name']}" for m in complex_]
    unused = sorted(shop["unused_measures"].collect(), key=lambda m: (-m["complexity_score"], m["name"], m["table"]))[:10]
    assert listed(blocks["expressions"], "Unused measures") == [f"- {m['name']} ({m['table']}): complexity {m['complexity_score']}" for m in unused]
    functions = listed(blocks["expressions"], "Most used functions")
    assert functions == [f"- {t['token']}: {t['n']}" for t in sorted(prompts.token_usage(shop["measures"]).collect(), key=lambda t: t["rank"])]
    degree = {}
    for e in shop["relationships"].where("is_active").collect():
        for t in (e["from_table"], e["to_table"]):
            degree[t] = degree.get(t, 0) + 1
    hubs = sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert listed(blocks["performance"], "Hub tables") == [f"- {t}: {n} relationships" for t, n in hubs]
    worst = sorted(shop["column_usage"].collect(), key=lambda u: (-u["unused_columns"], u["table"]))[:5]
    assert [x.split(" columns unused")[0] for x in listed(blocks["quality"], "Tables with most column waste")] == [f"- {u['table']}: {u['unused_columns']} of {u['total_columns']}" for u in worst]


def test_sections_on_unused(shop):
    def section(lines, title):
        rows = sorted((x["section_no"], x["line_no"], x["line"]) for x in lines)
        (no,) = [s for s, _, x in rows if x == f"## {title}"]
        return [x for s, n, x in rows if s == no and n > 10]

    technical, extended = documents.technical(shop).collect(), documents.extended(shop).collect()
    s = shop["unused_summary"].first()
    assert section(technical, "Cleanup risk") == [f"| {k} | {s[c]} |" for k, c in (("Safe delete", "safe_delete"), ("Review suggested", "review_suggested"), ("Investigate", "investigate"), ("Do not delete", "do_not_delete"))]
    unused = sorted(shop["unused_measures"].collect(), key=lambda m: (-m["complexity_score"], m["name"], m["table"]))[:10]
    assert [x.split(" | ")[1] for x in section(extended, "Unused measures")] == [m["name"] for m in unused]
    assert len(section(extended, "Column use")) == shop["column_usage"].count()
    assert f"- Unused columns: {shop['usage_summary'].first()['total_unused']}" in section(extended, "Column use summary")
    meta = shop["score_metadata"].first()
    assert section(extended, "Model statistics")[:3] == [f"- Tables: {meta['total_tables']}", f"- Relationships: {meta['total_relationships']}", f"- Measures: {meta['total_measures']}"]
    counts = {r["classification"]: r["count"] for r in shop["classifications"].groupBy("classification").count().collect()}
    assert section(extended, "Table distribution")[0] == f"- Fact tables: {counts.get('FACT', 0)}"
    assert len(section(technical, "Data sources")) == shop["datasources"].count() and len(section(technical, "Composition")) == shop["tables"].count()
    assert [x[2:].rsplit(" (", 1)[0] for x in section(technical, "Most complex unused measures")] == [m["name"] for m in unused][:5]
    total = shop["category_totals"].first()
    assert section(technical, "Visuals by category")[0].startswith(f"| Chart | {total['chart_count']} |")
    assert len(section(technical, "Least used tables")) == min(5, shop["column_usage"].count())
    compliance = documents.compliance(shop).collect()
    assert len(section(compliance, "Points")) == shop["issues"].count()
    assert section(compliance, "Notes") == [f"- The model dimension cannot score more than its schema type allows: {meta['schema_type']}"]


def test_project_without_measures_has_prompts(spark):
    bare = model_projects.files(spark, "shop").withColumn("content", F.regexp_replace("content", r"(?m)^\tmeasure ", "\tnothing "))
    r = audit.relations(bare)
    assert r["measures"].count() == 0
    assert {p["block"] for p in prompts.prompts(r).collect()} == {"overview", "expressions", "performance", "quality"}


def test_charts_are_drawings(shop):
    """Each chart is well-formed, holds an element a row, and is shown in the extended document; names are escaped."""
    from xml.etree import ElementTree

    from auditloom.plans import charts, svg
    from auditloom.sources import sinks

    drawn = {r["document"]: ElementTree.fromstring(r["text"]) for r in sinks.assembled(svg.drawings(shop)).collect()}
    assert set(drawn) == set(svg.TITLES)
    count = lambda name, tag: len(drawn[name].findall(f"{{http://www.w3.org/2000/svg}}{tag}"))
    assert count("datatypes.svg", "rect") == charts.datatype_bars(shop["columns"]).count()
    assert count("measures.svg", "circle") == shop["measures"].count() and count("measures.svg", "line") == shop["measure_edges"].count()
    assert count("relationships.svg", "circle") == shop["tables"].count() and count("heatmap.svg", "rect") == 4 * shop["tables"].count()
    dashes = [int(x.get("stroke-dasharray").split()[0]) for x in drawn["classes.svg"] if x.get("stroke-dasharray")]
    assert sum(dashes) == 1000 and len(dashes) == count("classes.svg", "text")
    shown = [r["line"] for r in documents.extended(shop).where("section_no = 14").orderBy("line_no").collect()]
    assert shown[0] == "## Charts" and "![Data types](datatypes.svg)" in shown
    odd = svg.datatype_bars(shop["columns"].selectExpr("'p' AS project", "'<&>' AS name", "'<x>' AS data_type").limit(1))
    assert any("Other (&lt;x&gt;)" in r["line"] for r in odd.collect())


def test_every_link_of_the_contents_meets_a_heading(spark):
    rows = [("p", "d", 0, 0, "# Title"), ("p", "d", 1, 0, "## Pages & [more]"), ("p", "d", 2, 0, "## Pages"), ("p", "d", 3, 0, "## Pages"), ("p", "d", 3, 4, "### Été 2"), ("p", "e", 0, 0, "# Alone"), ("q", "d", 2, 0, "## Pages"), ("q", "d", 2, 1, "#nothing")]
    lines = spark.createDataFrame(rows, "project string, document string, section_no int, line_no int, line string")
    out = documents.contents(lines)
    slugs = {(r["project"], r["document"], r["slug"]) for r in documents.headings(lines).collect()}
    assert {s for p, d, s in slugs if (p, d) == ("p", "d")} == {"title", "pages--more", "pages", "pages-1", "été-2"}
    links = [(r["project"], r["document"], r["line"].split("(#")[1][:-1]) for r in out.where("line LIKE '%](#%'").collect()]
    assert len(links) == 5 and set(links) <= slugs
    got = [r["line"] for r in out.where("project = 'p' AND document = 'd'").orderBy("section_no", "line_no").collect()]
    assert got[:7] == ["# Title", "**Contents**", "", r"- [Pages & \[more\]](#pages--more)", "- [Pages](#pages)", "- [Pages](#pages-1)", "  - [Été 2](#été-2)"]
    assert out.where("document = 'e'").count() == 1
    name = lines.select(documents.file_name(F.lit("2024-05-06 07:08:09").cast("timestamp"))).first()[0]
    assert name == "p_d_20240506_070809.md"
