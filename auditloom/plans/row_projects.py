"""Projects written from the rows of the given tables: what the queries on definition and report files read.

A nation is a project. Its parts are columns, a brand's parts are one table; its customers
are measures that refer to each other, some of them in rings; its users are
pages and their events visuals. The text is made by SQL that both engines run,
so it grows with the tables; nothing of it is fixed but the wording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LINE, TAB, QUOTE = "chr(10)", "chr(9)", "chr(39)"
TABLES = ("nation", "part", "customer", "events")
Join = Callable[[str, str], str]


def spark_join(text: str, order: str) -> str:
    return f"string_agg({text}, '') WITHIN GROUP (ORDER BY {order})"


def duck_join(text: str, order: str) -> str:
    return f"string_agg({text}, '' ORDER BY {order})"


def _text(template: str) -> str:
    """SQL for a text: ``<x>`` is the expression x as text; line ends, tabs, quotes and braces become calls, which both engines read alike."""
    out = []
    for k, piece in enumerate(template.replace(">", "<").split("<")):
        if k % 2:
            out.append(f"CAST({piece} AS VARCHAR(1000000))")
            continue
        for sign, call in (("\n", LINE), ("\t", TAB), ("'", QUOTE), ("{", "chr(123)"), ("}", "chr(125)"), ("~", "chr(62)"), ("^", "chr(96)")):
            piece = piece.replace(sign, f"\0{call}\0")
        out += [x if x.startswith("chr(") else f"'{x}'" for x in piece.split("\0") if x]
    return "(" + " || ".join(out) + ")"


def _case(number: str, *texts: str) -> str:
    return "CASE " + f"({number}) % {len(texts)} " + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(texts)) + " END"


def _half(number: str, by: int) -> str:
    return f"CAST(floor(({number}) / {by}.0) AS BIGINT)"


def _column(key: str) -> str:
    """The name of a part's column."""
    return _case(key, f"Ring Key <{key}>", f"R<{key}>", f"Store Key <{key}>", f"Label<{key}>", f"Order Date <{key}>", f"Active<{key}>", f"City<{key}>")


#: A part's lines, by its key.
_COLUMN = _case(
    "k",
    "\tcolumn 'Ring Key <k>'\n\t\tdataType: int64\n\t\tsourceColumn: ring_<k>\n\t\tsummarizeBy: none\n\n",
    "\tcolumn R<k>\n\t\tdataType: double\n\t\tformatString: 0.00\n\t\tsummarizeBy: sum\n",
    "\tcolumn 'Store Key <k>'\n\t\tdataType: string\n\t\tisHidden\n",
    '\tcolumn Label<k> = [R<k>] & "-" & [Kind]\n\t\tdataType: string\n',
    "\tcolumn 'Order Date <k>'\n\t\tdataType: dateTime\n\t\tdescription: <p_name>\n",
    "\tcolumn Active<k>\n\t\tdataType: boolean\n\t\tisHidden: true\n",
    "\tcolumn City<k>\n\t\tdataType: string\n\t\tdataCategory: City\n\t\tsourceColumn: <p_type>\n",
)
#: A brand's table: its name, and what follows its columns.
_STEM = _case("b", "fact_B<b>", "dim_B<b>", "B<b> lookup", "bridge_B<b>", "Slicer B<b>", "salary_B<b>", "LocalDateTable_B<b>", "calendar_B<b>")
_SOURCE = _case(
    "b + n",
    '\tpartition p<b> = m\n\t\tmode: import\n\t\tsource =\n\t\t\t\tlet\n\t\t\t\t\tSource = Sql.Database("db<n>.example.org", "shop<b>"),\n\t\t\t\t\tT = Source{[Item="b<b>"]}[Data]\n\t\t\t\tin\n\t\t\t\t\tT\n\n\tannotation Owner = team-<n>\n',
    '\tpartition p<b> = m\n\t\tsource = Csv.Document(File.Contents("C:/data/b<b>.csv"))\n',
    "\tpartition p<b> = calculated\n\t\tsource = CALENDAR(DATE(2020,1,1), DATE(2024,12,<b>))\n",
    '\tpartition p<b> = m\n\t\tsource = Excel.Workbook(Web.Contents("https://files<n>.example.org/b<b>.xlsx"))\n',
    '\tpartition p<b> = calculated\n\t\tsource = DATATABLE("Choice", STRING, {{"a"}, {"b"}})\n',
    '\tpartition p<b> = m\n\t\tmode: directQuery\n\t\tsource = PostgreSQL.Database("pg<n>.example.org", "people")\n\tpartition q<b> = m\n\t\tsource = "no call"\n',
    '\tpartition p<b> = m\n\t\tsource = SharePoint.Files("https://share.example.org/b<b>")\n',
)
#: A customer's measure, by its number among the nation's customers.
_MEASURE = _case(
    "r",
    '\tmeasure M<r> = SUMX(fact_B8, fact_B8[R<8 * r + 1>] * 2)\n\t\tformatString: "0.00"\n\t\tdescription: "Money of <c_mktsegment>"\n\n',
    f"\tmeasure M<r> = [M<{_half('r', 2)}>] - [M<{_half('r', 3)}>]\n",
    f"\tmeasure 'M<r>' = [M<{_half('r', 2)}>] / [M<{_half('r', 3)}>]\n\t\tformatString: 0%\n",
    f"\tmeasure M<r> =\n\t\t\tVAR base = [M<{_half('r', 2)}>]\n\t\t\tVAR last = CALCULATE([M<{_half('r', 2)}>], SAMEPERIODLASTYEAR(calendar_B7[R<r>]))\n\t\t\tRETURN\n\t\t\t\tDIVIDE(base - last, last)\n\t\tformatString: \"0.0%\"\n\t\tdisplayFolder: Rates\n\n",
    f"\tmeasure M<r> = COUNTX(FILTER(fact_B8, fact_B8[R<r>] ~ <c_custkey>), [M<{_half('r', 2)}>])\n",
    f'\tmeasure M<r> = IF([M<{_half("r", 2)}>] ~ <c_custkey>, "a", IF([M<{_half("r", 3)}>] ~ 50, "b", IF([M<{_half("r", 2)}>] ~ 10, "c", "d")))\n\t\tdescription: <c_mktsegment>\n',
    f"\tmeasure M<r> = ^^^\n\t\t\tSUMX(dim_B9, SUMX(fact_B8, [M<{_half('r', 3)}>] * 2))\n\t\t\t^^^\n",
    "\tmeasure M<r> = 1\n",
    "\tmeasure M<r> = [M<r + 1>] + 1\n",
    "\tmeasure M<r> = [M<r + 1>] + 1\n",
    "\tmeasure M<r> = [M<r - 2>] + 1\n",
    "\tmeasure M<r> = CALCULATE(COUNTROWS(fact_B8), ALL(dim_B9), fact_B8[Active<r>] = TRUE)\n\t\tisHidden\n\t\tdescription: People\n",
)
_EDGE = _case(
    "f.b + d.b + f.n",
    "relationship r<f.b>x<d.b>\n\tfromColumn: <f.stem>.'<f.own>'\n\ttoColumn: <d.stem>.'<d.own>'\n\n",
    "relationship r<f.b>x<d.b>\n\tfromColumn: <f.stem>.'<f.own>'\n\ttoColumn: <d.stem>.'<d.own>'\n\tcrossFilteringBehavior: bothDirections\n\n",
    "relationship r<f.b>x<d.b>\n\tisActive: false\n\tfromCardinality: many\n\ttoCardinality: many\n\tfromColumn: <f.stem>[<f.own>]\n\ttoColumn: <d.stem>[<d.own>]\n\n",
    "relationship r<f.b>x<d.b>\n\tfromColumn: <f.stem>.'<f.own>'\n\ttoColumn: <d.stem>.'<d.own>'\n\n",
    "relationship broken<d.b>\n\tfromColumn: <f.stem>.Nothing\n",
)


def _visual(kind: str, roles: str) -> str:
    return '{"visual": {"visualType": "' + kind + '", "query": {"queryState": {' + roles + "}}}}"


def _role(role: str, *names: str) -> str:
    return f'"{role}": {{"projections": [' + ", ".join(f'{{"nativeQueryRef": "{n}"}}' for n in names) + "]}"


_KEY, _OTHER = "25 * (event_id % 40) + user_id % 25", "25 * (event_id % 17) + user_id % 25"
_VISUAL = _case(
    "event_id",
    _visual("columnChart", _role("Values", "M<event_id % 70>") + ", " + _role("Category", f"<{_column(_KEY)}>")),
    _visual("pivotTable", _role("Rows", f"<{_column(_KEY)}>") + ", " + _role("Columns", f"<{_column(_OTHER)}>") + ", " + _role("Values", "M<event_id % 41>", "M<event_id % 13>")),
    _visual("slicer", _role("Values", f"dim_B9.<{_column(_KEY)}>")),
    _visual("KPI", _role("Values", "M<event_id % 29>")),
    '{"isHidden": true, "visual": {"visualType": "textbox"}}',
    _visual("card", _role("Values", "fact_B8[<event_type>]")),
    "{not json <event_id>",
    _visual("lineChart", _role("Category", f"<{_column(_OTHER)}>") + ", " + _role("Values", "M<event_id % 70>")),
    _visual("matrix", _role("Rows", f"<{_column(_KEY)}>") + ", " + _role("Values", "M<event_id % 19>")),
)


def files_sql(join: Join) -> str:
    """CTEs that end in ``files`` (project, rel_path, file_stem, content)."""
    rows = ", ".join
    return rows((
        "part_rows AS (SELECT p_partkey AS k, p_partkey % 25 AS n, CAST(substr(p_brand, 7) AS BIGINT) AS b, p_name, p_type FROM {part})",
        f"tables_of AS (SELECT n, b, {_STEM} AS stem, min(k) AS low, {join(_COLUMN, 'k')} AS body FROM part_rows GROUP BY n, b)",
        f"named AS (SELECT *, {_column('low')} AS own FROM tables_of)",
        "ranked AS (SELECT c_nationkey AS n, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM {customer})",
        f"""files AS (
    SELECT {_text("n<n>")} AS project, {_text("tables/<stem>.tmdl")} AS rel_path, stem AS file_stem, {_text("table <stem>\n<body>")} || {_SOURCE} AS content FROM named
    UNION ALL SELECT {_text("n<n>")}, {_text("tables/<t>.tmdl")}, t, {_text("table <t>\n")} || body FROM (SELECT n, CASE WHEN n % 2 = 0 THEN '_Measures' ELSE 'Sheet1' END AS t, {join(_MEASURE, 'r')} AS body FROM ranked GROUP BY n)
    UNION ALL SELECT {_text("n<f.n>")}, 'relationships.tmdl', 'relationships', {join(_EDGE, 'f.b, d.b')} FROM named f JOIN named d ON d.n = f.n WHERE f.b % 8 = 0 AND d.b % 8 IN (1, 3) AND f.n % 5 < 4 GROUP BY f.n
    UNION ALL SELECT {_text("n<n_nationkey>")}, 'expressions.tmdl', 'expressions', {_text('expression Feed = OData.Feed("https://feeds.example.org/<n_name>")\n\nexpression Old = OData.Feed("https://feeds.example.org/<n_name>")\n')} FROM {{nation}}
    UNION ALL SELECT {_text("n<n_nationkey>")}, 'model.tmdl', 'model', {_text("model Model\n\tsource = see https://wiki.example.org/odata\n")} FROM {{nation}} WHERE n_nationkey % 3 = 0)""",
    ))


def report_sql(join: Join) -> str:
    """CTEs that end in ``report`` (project, page_id, visual_id, content). Every fifth project has none."""
    pages = "(SELECT DISTINCT user_id FROM {events} WHERE user_id % 5 < 4)"
    listed = join('CASE WHEN user_id < 25 THEN ' + _text('"p<user_id>"') + " ELSE " + _text(', "p<user_id>"') + " END", "user_id")
    return f"""report AS (
    SELECT {_text("n<user_id % 25>")} AS project, CAST(NULL AS VARCHAR(100)) AS page_id, CAST(NULL AS VARCHAR(100)) AS visual_id, {_text('{"pageOrder": [')} || {listed} || {_text("]}")} AS content FROM {pages} GROUP BY user_id % 25
    UNION ALL SELECT {_text("n<user_id % 25>")}, {_text("p<user_id>")}, CAST(NULL AS VARCHAR(100)), {_text('{"displayName": "Page <user_id>"}')} FROM {pages}
    UNION ALL SELECT {_text("n<user_id % 25>")}, {_text("p<user_id>")}, {_text("v<event_id>")}, {_VISUAL} FROM {{events}} WHERE user_id % 5 < 4)"""


def _run(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in query})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, rel_path, file_stem and content of the projects' definition files."""
    return _run(spark, sf_dir, f"WITH {files_sql(spark_join)} SELECT * FROM files")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, page_id, visual_id and content of the projects' report files."""
    return _run(spark, sf_dir, f"WITH {report_sql(spark_join)} SELECT * FROM report")


def duck_files() -> str:
    return files_sql(duck_join).format(**{t: t for t in TABLES})


def duck_report() -> str:
    return report_sql(duck_join).format(**{t: t for t in TABLES})
