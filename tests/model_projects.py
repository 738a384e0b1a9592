"""Three small projects of our own, as text: what the queries on definition files read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SALES = """table sales
\tlineageTag: 11

\tcolumn 'Order Key'
\t\tdataType: int64
\t\tsourceColumn: order_key
\t\tsummarizeBy: none

\tcolumn 'Customer Key'
\t\tdataType: int64
\t\tisHidden
\t\tsummarizeBy: none

\tcolumn Quantity
\t\tdataType: int64
\t\tsummarizeBy: sum

\tcolumn Price
\t\tdataType: double
\t\tformatString: 0.00
\t\tsummarizeBy: sum

\tcolumn Cost
\t\tdataType: decimal
\t\tsummarizeBy: sum

\tcolumn 'Line Label' = [Order Key] & "-" & [Quantity]
\t\tdataType: string

\tcolumn 'Order Date'
\t\tdataType: dateTime

\tcolumn 'Date Key'
\t\tdataType: int64

\tcolumn 'Store Key'
\t\tdataType: string

\tpartition sales = m
\t\tmode: import
\t\tsource =
\t\t\t\tlet
\t\t\t\t\tSource = Sql.Database("db.example.org", "shop"),
\t\t\t\t\tT = Source{[Item="sales"]}[Data]
\t\t\t\tin
\t\t\t\t\tT

\tannotation Owner = team-a
"""

CUSTOMER = """table dim_customer
\tcolumn 'Customer Key'
\t\tdataType: int64
\tcolumn Name
\t\tdataType: string
\tcolumn City
\t\tdataType: string
\t\tdataCategory: City
\tcolumn Active
\t\tdataType: boolean
\tpartition dim_customer = m
\t\tsource = Csv.Document(File.Contents("C:/data/customers.csv"))
"""

CALENDAR = """table calendar
\tcolumn 'Date Key'
\t\tdataType: int64
\tcolumn Date
\t\tdataType: dateTime
\tcolumn 'Month Start'
\t\tdataType: dateTime
\tpartition calendar = calculated
\t\tsource = CALENDAR(DATE(2020,1,1), DATE(2024,12,31))
"""

STORE = """table dim_store
\tcolumn 'Store Key'
\t\tdataType: string
\tcolumn Region
\t\tdataType: string
\tpartition dim_store = m
\t\tsource = Excel.Workbook(Web.Contents("https://files.example.org/stores.xlsx"))
"""

MEASURES = """table _Measures
\tmeasure Revenue = SUMX(sales, sales[Quantity] * sales[Price])
\t\tformatString: "0.00"
\t\tdescription: "Money in"

\tmeasure 'Total Cost' = SUM(sales[Cost])
\t\tformatString: "0.00"

\tmeasure Margin = [Revenue] - [Total Cost]

\tmeasure 'Margin Rate' = [Margin] / [Revenue]

\tmeasure 'Margin Rate LY' =
\t\t\tVAR base = [Margin Rate]
\t\t\tVAR last = CALCULATE([Margin Rate], SAMEPERIODLASTYEAR(calendar[Date]))
\t\t\tRETURN
\t\t\t\tDIVIDE(base - last, last)
\t\tformatString: "0.0%"
\t\tdisplayFolder: Rates

\tmeasure 'Big Orders' = COUNTX(FILTER(sales, sales[Quantity] > 10), [Revenue])

\tmeasure Band = IF([Revenue] > 100, "a", IF([Revenue] > 50, "b", IF([Revenue] > 10, "c", "d")))

\tmeasure Nested = ```
\t\t\tSUMX(dim_customer, SUMX(sales, [Revenue] * 2))
\t\t\t```

\tmeasure Stub = 1

\tmeasure Cycle1 = [Cycle2] + 1
\tmeasure Cycle2 = [Cycle3] + 1
\tmeasure Cycle3 = [Cycle1] + 1
"""

PARAMETER = """table Slicer Choice
\tcolumn Choice
\t\tdataType: string
\tpartition p = calculated
\t\tsource = DATATABLE("Choice", STRING, {{"a"}, {"b"}})
"""

RELATIONSHIPS = """relationship r1
\tfromColumn: sales.'Customer Key'
\ttoColumn: dim_customer.'Customer Key'

relationship r2
\tfromColumn: sales.'Date Key'
\ttoColumn: calendar.'Date Key'

relationship r3
\tfromColumn: sales.'Store Key'
\ttoColumn: dim_store.'Store Key'
\tcrossFilteringBehavior: bothDirections

relationship r4
\tisActive: false
\tfromCardinality: many
\ttoCardinality: many
\tfromColumn: sales[Order Date]
\ttoColumn: calendar[Date]

relationship broken
\tfromColumn: sales.Quantity
"""

EXPRESSIONS = """expression Feed = OData.Feed("https://feeds.example.org/v4")

expression 'Old Feed' = OData.Feed("https://feeds.example.org/v4")
"""

FILES = {
    "tables/sales.tmdl": SALES, "tables/dim_customer.tmdl": CUSTOMER, "tables/calendar.tmdl": CALENDAR, "tables/dim_store.tmdl": STORE,
    "tables/_Measures.tmdl": MEASURES, "tables/Slicer Choice.tmdl": PARAMETER, "relationships.tmdl": RELATIONSHIPS, "expressions.tmdl": EXPRESSIONS,
}

#: A project without a report: two tables that nothing connects, measures beside the columns.
FLAT_FILES = {
    "tables/Sheet1.tmdl": """table Sheet1
\tcolumn Email Address
\t\tdataType: string
\tcolumn 'Pay Code' = ```
\t\t\t[Email Address] & "x"
\t\t\t```
\t\tdataType: string
\tcolumn Paid
\t\tdataType: boolean
\t\tisHidden: true
\tmeasure 'Head Count' =
\t\t\tVAR n = COUNTROWS(Sheet1)
\t\t\tVAR m = COUNTA(Sheet1[Paid])
\t\t\tVAR k = MAX(Sheet1[Paid])
\t\t\tVAR o = MIN(Sheet1[Paid])
\t\t\tVAR p = 1
\t\t\tRETURN IF(n > m, n, DIVIDE(n, m))
\t\tisHidden
\t\tdescription: People
\tmeasure Ratio = [Head Count] / COUNTA(Sheet1[Paid])
\tpartition Sheet1 = m
\t\tmode: directQuery
\t\tsource = PostgreSQL.Database("pg.example.org", "people")
""",
    "tables/salary_2020.tmdl": """table salary_2020
\tisHidden
\tannotation Note = 'own'
\tcolumn Amount
\t\tdataType: decimal
\t\tsummarizeBy: sum
\tcolumn Country
\t\tdataType: string
\t\tdataCategory: Country
\tpartition a = m
\t\tsource = SharePoint.Files("https://share.example.org/pay")
\tpartition b = m
\t\tsource = "no call"
""",
}

#: A project with tables that the product makes itself, two facts and a bridge.
WIDE_FILES = {
    "tables/fact_orders.tmdl": """table fact_orders
\tcolumn customer_id
\t\tdataType: int64
\tcolumn store_id
\t\tdataType: int64
\tcolumn date_id
\t\tdataType: int64
\tcolumn amount
\t\tdataType: double
\t\tsummarizeBy: sum
\tcolumn net
\t\tdataType: double
\t\tsummarizeBy: sum
\tcolumn tax
\t\tdataType: double
\t\tsummarizeBy: sum
\tcolumn doubled = [amount] * 2
\t\tdataType: double
\tpartition fact_orders = m
\t\tsource = Sql.Database("wide.example.org", "dw", [Query="select 1"])
""",
    "tables/fact_returns.tmdl": """table fact_returns
\tcolumn customer_id
\t\tdataType: int64
\tcolumn store_id
\t\tdataType: int64
\tcolumn date_id
\t\tdataType: int64
\tcolumn amount
\t\tdataType: double
\t\tsummarizeBy: sum
\tpartition fact_returns = m
\t\tsource = Sql.Database("wide.example.org", "dw")
""",
    "tables/dim_customer.tmdl": "table dim_customer\n\tcolumn customer_id\n\t\tdataType: int64\n\tcolumn name\n\t\tdataType: string\n\tpartition c = m\n\t\tsource = Web.Contents('http://x.example.org/c.json')\n",
    "tables/dim_store.tmdl": "table dim_store\n\tcolumn store_id\n\t\tdataType: int64\n\tcolumn opened\n\t\tdataType: dateTime\n\tcolumn closed\n\t\tdataType: dateTime\n",
    "tables/dim_date.tmdl": "table dim_date\n\tcolumn date_id\n\t\tdataType: int64\n\tcolumn day\n\t\tdataType: dateTime\n",
    "tables/bridge_map.tmdl": "table bridge_map\n\tcolumn customer_id\n\t\tdataType: string\n\tcolumn store_id\n\t\tdataType: int64\n",
    "tables/LocalDateTable_1.tmdl": "table LocalDateTable_1\n\tcolumn Date\n\t\tdataType: dateTime\n\tmeasure Hidden = 1 + 1\n",
    "tables/Calculations.tmdl": """table Calculations
\tmeasure Total = SUM(fact_orders[amount])
\t\tformatString: #,0
\t\tdescription: All orders
\tmeasure Back = SUM(fact_returns[amount])
\t\tformatString: #,0
\t\tdescription: All returns
\tmeasure Share = DIVIDE([Back], [Total])
\t\tformatString: 0%
\t\tdescription: Part
\tmeasure Rank = RANKX(ALL(dim_store), [Total])
\t\tformatString: 0
\t\tdescription: Place
""",
    "relationships.tmdl": "".join(f"relationship {k}\n\tfromColumn: {a}\n\ttoColumn: {b}\n{more}\n" for k, a, b, more in (
        ("w1", "fact_orders.customer_id", "dim_customer.customer_id", ""), ("w2", "fact_orders.store_id", "dim_store.store_id", ""), ("w3", "fact_orders.date_id", "dim_date.date_id", ""),
        ("w4", "fact_returns.customer_id", "dim_customer.customer_id", ""), ("w5", "fact_returns.store_id", "dim_store.store_id", ""), ("w6", "fact_returns.date_id", "dim_date.date_id", ""),
        ("w7", "bridge_map.customer_id", "dim_customer.customer_id", "\tfromCardinality: one\n\ttoCardinality: one\n"),
    )),
    "model.tmdl": "model Model\n\tsource = see https://wiki.example.org/odata\n",
}


def _visual(kind: str, **roles: list[str]) -> str:
    import json

    return json.dumps({"visual": {"visualType": kind, "query": {"queryState": {r: {"projections": [{"nativeQueryRef": n} for n in names]} for r, names in roles.items()}}}})


REPORT = [
    (None, None, '{"pageOrder": ["p1", "p2"]}'),
    ("p1", None, '{"displayName": "Overview"}'),
    ("p2", None, '{"displayName": "Details"}'),
    ("p1", "v1", _visual("columnChart", Values=["Margin Rate LY"], Category=["Region"])),
    ("p1", "v2", _visual("pivotTable", Rows=["Name"], Columns=["Month Start"], Values=["Revenue", "Total Cost"])),
    ("p1", "v3", _visual("slicer", Values=["dim_store.Region"])),
    ("p1", "v4", _visual("KPI", Values=["Margin"])),
    ("p1", "v5", "{not json"),
    *[("p2", f"c{i:02d}", _visual("card", Values=["Band"])) for i in range(13)],
]


WIDE_REPORT = [
    (None, None, '[{"id": "a"}, {"name": "b"}]'),
    ("a", None, '{"displayName": "First"}'),
    *[("a", f"v{i}", _visual("lineChart", Category=["day"], Values=["Total"])) for i in range(9)],
    ("a", "t", _visual("matrix", Rows=["name"], Values=["Rank"])),
    ("a", "s", _visual("slicer", Values=["fact_orders.amount"])),
    ("a", "h", '{"isHidden": true, "visual": {"visualType": "textbox"}}'),
]

#: project: (definition files, report files or None)
PROJECTS = {"shop": (FILES, REPORT), "flat": (FLAT_FILES, None), "wide": (WIDE_FILES, WIDE_REPORT)}


def file_rows() -> list[tuple]:
    return [(project, path, path.rsplit("/", 1)[-1].removesuffix(".tmdl"), text) for project, (own, _) in PROJECTS.items() for path, text in own.items()]


def report_rows() -> list[tuple]:
    return [(project, *r) for project, (_, own) in PROJECTS.items() for r in own or ()]


def files(spark: SparkSession, *projects: str) -> DataFrame:
    """project, rel_path, file_stem, content of the definition files (of all projects, if none is named)."""
    rows = [r for r in file_rows() if not projects or r[0] in projects]
    return spark.createDataFrame(rows, "project string, rel_path string, file_stem string, content string")


def report(spark: SparkSession, *projects: str) -> DataFrame:
    rows = [r for r in report_rows() if not projects or r[0] in projects]
    return spark.createDataFrame(rows, "project string, page_id string, visual_id string, content string")
