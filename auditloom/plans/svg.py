"""Charts as SVG, as ordered lines like the documents: project, document, section_no, line_no, line.

An element is a line, placed by its rank within the project; nothing is collected, so a
chart of any size is written by as many tasks as its rows have. All coordinates are whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import charts

#: Width of a drawing, height of a row, and the fill of classes, kinds and levels.
WIDTH, ROW, LABEL = 960, 24, 240
FILLS = {
    "FACT": "#c0392b", "DIMENSION": "#2980b9", "BRIDGE": "#8e44ad", "CALCULATION": "#27ae60", "PARAMETER": "#f39c12",
    "fact": "#c0392b", "dimension": "#2980b9", "bridge": "#8e44ad", "measure": "#27ae60", "other": "#7f8c8d",
    "low": "#27ae60", "medium": "#f39c12", "high": "#c0392b",
}
METRICS = ("column_metric", "measure_metric", "relationship_metric", "complexity")
KINDS = ("fact", "bridge", "dimension", "measure", "other")


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _whole(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def _fill(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FILLS.items() for x in kv)), c), F.lit("#7f8c8d"))


def _element(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` replaced by columns."""
    pieces: list[Column] = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        if piece:
            pieces.append(values[piece].cast("string") if k % 2 else F.lit(piece))
    return F.concat(*pieces)


def _drawing(rows: DataFrame, document: str, height: Column, *layers: DataFrame) -> DataFrame:
    """``layers`` (project, line_no, line), one above the other, between the head and the end of a drawing. ``height`` is an aggregate of ``rows``."""
    size = rows.groupBy("project").agg(height.cast("long").alias("height"))
    head = size.select("project", F.lit(0).alias("section_no"), F.lit(0).cast("long").alias("line_no"), _element(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{{h}}" font-family="sans-serif" font-size="12">', h=F.col("height")).alias("line"))
    end = size.select("project", F.lit(99).alias("section_no"), F.lit(0).cast("long").alias("line_no"), F.lit("</svg>").alias("line"))
    body = [x.select("project", F.lit(k).alias("section_no"), F.col("line_no").cast("long").alias("line_no"), "line") for k, x in enumerate(layers, 1)]
    return reduce(lambda a, b: a.unionByName(b), [head, *body, end]).select("project", F.lit(document).alias("document"), "section_no", "line_no", "line")


def _ranked(rows: DataFrame, *order: Column | str, by: tuple[str, ...] = ("project",)) -> DataFrame:
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def datatype_bars(columns: DataFrame) -> DataFrame:
    """A bar a display type, the most frequent first."""
    bars = _ranked(charts.datatype_bars(columns), F.desc("n"), "display_type")
    most = F.max("n").over(Window.partitionBy("project"))
    y = F.col("line_no") * ROW
    line = _element(
        f'<text x="8" y="{{t}}">{{name}}</text><rect x="{LABEL}" y="{{y}}" width="{{w}}" height="{ROW - 6}" fill="#2980b9"/><text x="{{e}}" y="{{t}}">{{n}}</text>',
        t=y + 14, y=y, name=_escaped(F.col("display_type")), w=F.col("w"), e=F.col("w") + LABEL + 6, n=F.col("n"),
    )
    sized = bars.withColumn("w", _whole(F.col("n") * 600.0 / most))
    return _drawing(bars, "datatypes.svg", (F.count("*") + 2) * ROW, sized.select("project", "line_no", line.alias("line")))


def class_donut(classes: DataFrame) -> DataFrame:
    """A ring of class shares: arcs are dashes of a circle whose whole length is 1000."""
    n = classes.groupBy("project", "classification").agg(F.count("*").alias("n"))
    own = Window.partitionBy("project")
    before = F.sum("n").over(own.orderBy("classification").rowsBetween(Window.unboundedPreceding, -1))
    parts = _ranked(n, "classification").withColumn("all", F.sum("n").over(own)).withColumn("before", F.coalesce(before, F.lit(0)))
    a, b = _whole(F.col("before") * 1000.0 / F.col("all")), _whole((F.col("before") + F.col("n")) * 1000.0 / F.col("all"))
    ring = _element('<circle cx="160" cy="160" r="100" fill="none" stroke="{f}" stroke-width="48" pathLength="1000" stroke-dasharray="{d} 1000" stroke-dashoffset="{o}"/>', f=_fill(F.col("classification")), d=b - a, o=-a)
    text = _element('<text x="320" y="{y}" fill="{f}">{name}: {n}</text>', y=F.col("line_no") * ROW + 40, f=_fill(F.col("classification")), name=F.col("classification"), n=F.col("n"))
    return _drawing(n, "classes.svg", F.lit(340) + F.count("*") * 0, parts.select("project", "line_no", ring.alias("line")), parts.select("project", "line_no", text.alias("line")))


def heat_cells(heat: DataFrame) -> DataFrame:
    """A row of cells for each of the tables that weigh most; the fuller a cell, the larger its metric (10 is full)."""
    cells = heat.select("project", "table", "rank", F.posexplode(F.array(*(F.col(c).cast("double") for c in METRICS))).alias("k", "value"))
    share = F.least(_whole(F.col("value") * 10), F.lit(100))
    y = F.col("rank") * ROW
    cell = _element(f'<rect x="{{x}}" y="{{y}}" width="116" height="{ROW - 2}" fill="#c0392b" fill-opacity="{{o}}%"/>', x=F.col("k") * 120 + LABEL, y=y, o=share)
    name = _element('<text x="8" y="{y}">{t}</text>', y=y + 15, t=_escaped(F.col("table")))
    return _drawing(heat, "heatmap.svg", (F.count("*") + 2) * ROW, heat.select("project", F.col("rank").alias("line_no"), name.alias("line")), cells.select("project", (F.col("rank") * 10 + F.col("k")).alias("line_no"), cell.alias("line")))


def relationship_map(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables in a column a kind, by name; a line for each related pair, dashed if many rows meet many."""
    nodes, links = charts.relationship_graph(tables, edges)
    column = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    spots = _ranked(nodes, "table", by=("project", "kind")).withColumn("x", column * 190 + 90).withColumn("y", F.col("line_no") * 2 * ROW)
    radius = F.least(F.lit(20), F.lit(6) + _whole(F.col("size") / 200.0))
    dot = _element('<circle cx="{x}" cy="{y}" r="{r}" fill="{f}"/><text x="{x}" y="{t}" text-anchor="middle">{n}</text>', x=F.col("x"), y=F.col("y"), r=radius, f=_fill(F.col("kind")), t=F.col("y") + 30, n=_escaped(F.col("table")))
    end = lambda side: spots.select("project", F.col("table").alias(f"{side}_table"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
    lines = _ranked(links.join(end("from"), ["project", "from_table"]).join(end("to"), ["project", "to_table"]), "from_table", "to_table")
    dash = F.when(F.col("cardinality") == "Many-to-Many", ' stroke-dasharray="4 4"').otherwise("")
    link = _element('<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="#555"{s}/>', a=F.col("from_x"), b=F.col("from_y"), c=F.col("to_x"), d=F.col("to_y"), s=dash)
    order = F.row_number().over(Window.partitionBy("project").orderBy("table")).cast("long")
    return _drawing(spots, "relationships.svg", F.max("y") + 3 * ROW, lines.select("project", "line_no", link.alias("line")), spots.select("project", order.alias("line_no"), dot.alias("line")))


def measure_map(measures: DataFrame, edges: DataFrame) -> DataFrame:
    """Measures in a column for each depth, by name; a line for each dependency. A depth that is not known is a column of its own, before the others."""
    nodes, links = charts.measure_graph(measures, edges)
    depth = F.coalesce("dependency_depth", F.lit(-1))
    spots = nodes.join(measures.select("project", "name", depth.cast("long").alias("depth")), ["project", "name"])
    spots = _ranked(spots, "name", by=("project", "depth")).withColumn("x", F.col("depth") * 140 + 150).withColumn("y", F.col("line_no") * ROW)
    dot = _element('<circle cx="{x}" cy="{y}" r="6" fill="{f}"/><text x="{t}" y="{u}">{n}</text>', x=F.col("x"), y=F.col("y"), f=_fill(F.col("level")), t=F.col("x") + 9, u=F.col("y") + 4, n=_escaped(F.col("name")))
    end = lambda name, side: spots.select("project", F.col("name").alias(name), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
    lines = _ranked(links.join(end("name", "from"), ["project", "name"]).join(end("dependency", "to"), ["project", "dependency"]), "name", "dependency")
    link = _element('<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="#999"/>', a=F.col("from_x"), b=F.col("from_y"), c=F.col("to_x"), d=F.col("to_y"))
    order = F.row_number().over(Window.partitionBy("project").orderBy("name")).cast("long")
    return _drawing(spots, "measures.svg", F.max("y") + 2 * ROW, lines.select("project", "line_no", link.alias("line")), spots.select("project", order.alias("line_no"), dot.alias("line")))


TITLES = {"datatypes.svg": "Data types", "classes.svg": "Table classes", "heatmap.svg": "Complexity", "relationships.svg": "Relationships", "measures.svg": "Measure dependencies"}


def drawings(r: Mapping[str, DataFrame]) -> DataFrame:
    """All charts of all projects; a project without rows for a chart has none."""
    heat = charts.heatmap(r["tables"], r["relationships"], r["measures"])
    return reduce(lambda a, b: a.unionByName(b), [datatype_bars(r["columns"]), class_donut(r["classifications"]), heat_cells(heat), relationship_map(r["tables"], r["relationships"]), measure_map(r["measures"], r["measure_edges"])])


def embedded(lines: DataFrame) -> DataFrame:
    """project and the line that shows a chart, for each chart that a project has."""
    title = F.element_at(F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv)), F.col("document"))
    return lines.where("section_no = 0").select("project", "document", F.concat(F.lit("!["), title, F.lit("]("), "document", F.lit(")")).alias("line"))
