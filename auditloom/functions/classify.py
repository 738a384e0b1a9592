"""Classifiers: first match wins, as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of key-like names.
KEY_PARTS = ("_id", " id", "id_", "key", "code", "codigo", "código", "sk_", "bk_")
#: Model data types by family.
NUMERIC_TYPES = ("double", "decimal", "int64", "int32", "currency")
GEOGRAPHY = ("city", "country", "stateorprovince", "postalcode", "latitude", "longitude")
CALCULATED_SIGNALS = ("DATATABLE", "SUMMARIZE", "SUMMARIZECOLUMNS", "ADDCOLUMNS", "SELECTCOLUMNS", "GENERATESERIES", "CALENDAR", "CALENDARAUTO", "UNION", "FILTER(")
#: Connector functions by source type.
CONNECTORS = {
    "SQL Server": ("Sql.Database", "AnalysisServices.Database"),
    "Excel": ("Excel.Workbook",),
    "CSV/Text": ("Csv.Document", "Lines.FromBinary"),
    "SharePoint": ("SharePoint.Files", "SharePoint.Contents", "SharePoint.Tables"),
    "OData Feed": ("OData.Feed",),
    "Web Source": ("Web.Contents", "Web.Page"),
    "Folder": ("Folder.Files", "Folder.Contents"),
    "File": ("File.Contents",),
    "Dataverse": ("CommonDataService.Database", "Dataverse.Contents"),
    "Power BI Dataflow": ("PowerPlatform.Dataflows", "PowerBI.Dataflows"),
    "Azure": ("AzureStorage.BlobContents", "AzureStorage.DataLake", "AzureDataExplorer.Contents"),
    "Oracle": ("Oracle.Database",),
    "PostgreSQL": ("PostgreSQL.Database",),
    "MySQL": ("MySQL.Database",),
}
#: Keywords by source type, in the order in which they are tried.
KEYWORDS = {
    "SQL Server": ("sql.database", "sql server", "sqlserver", "database.windows.net"),
    "Excel": ("excel.workbook", ".xlsx", ".xlsm", ".xls"),
    "CSV/Text": ("csv.document", ".csv", ".txt", "text/csv"),
    "SharePoint": ("sharepoint.files", "sharepoint.contents", "sharepoint.com"),
    "OData Feed": ("odata.feed", "odata"),
    "Web Source": ("web.contents", "https://", "http://"),
    "Folder": ("folder.files", "folder.contents"),
    "File": ("file.contents",),
    "Dataverse": ("commondataservice.database", "dataverse"),
    "Power BI Dataflow": ("powerplatform.dataflows", "powerbi.dataflows", "dataflows"),
    "Azure": ("azurestorage", "azuredatalake", "azuredataexplorer"),
    "Oracle": ("oracle.database",),
    "PostgreSQL": ("postgresql.database",),
    "MySQL": ("mysql.database",),
}
FILE_TYPES = ("Excel", "CSV/Text", "File", "Folder")
WEB_TYPES = ("Web Source", "OData Feed", "SharePoint")
CLOUD_TYPES = (*WEB_TYPES, "Dataverse", "Power BI Dataflow", "Azure")
DATABASE_TYPES = ("SQL Server", "Database", "Oracle", "PostgreSQL", "MySQL")
#: Visual types by category.
VISUALS = {
    "CHART": (
        "columnChart", "lineChart", "areaChart", "barChart", "scatterChart", "bubbleChart", "donutChart", "pieChart", "waterfallChart", "ribbonChart", "gaugeChart", "KPI",
        "lineClusteredColumnComboChart", "lineStackedColumnComboChart", "columnClusteredLineChart", "columnStackedLineChart", "comboChart", "clusteredBarChart",
        "stackedBarChart", "clusteredColumnChart", "stackedColumnChart", "stackedAreaChart", "clusteredAreaChart", "funnelChart", "treemapChart", "radialGaugeChart", "smallMultiple",
    ),
    "TABLE": ("table", "pivotTable", "matrix"),
    "SLICER": ("slicer", "ChicletSlicer1448559807354", "timeSlicer"),
    "BUTTON": ("actionButton", "button"),
    "TEXT": ("textbox", "shape"),
    "CARD": ("cardVisual", "card", "multiRowCard", "KPI"),
}
#: Words of a table's name that count for a class, and what they add.
NAME_WORDS = {
    "FACT": (("fact", "facts", "transaction", "transactions", "sales", "spend", "ledger"), 35),
    "DIMENSION": (("dim", "dimension", "master", "catalog", "lookup", "calendar", "date", "time", "period", "fiscal"), 30),
    "BRIDGE": (("bridge", "map", "mapping", "xref", "link"), 35),
    "CALCULATION": (("measure", "measures", "calculation", "calculations", "kpi", "metrics"), 35),
    "PARAMETER": (("parameter", "param", "selector", "slicer"), 35),
}
#: Grades and states by the least score that gets them.
GRADES = {"A": 85, "B": 75, "C": 60, "D": 45, "F": 0}
STATES = {"excellent": 90, "good": 75, "fair": 60, "poor": 40, "critical": 0}
#: Substrings of names and texts that decide a role, a kind, a source or a type.
DATE_WORDS = ("date", "fecha")
TEXT_WORDS = ("name", "nombre", "description", "descripcion", "descripción")
CALCULATION_WORDS = ("measure", "calculation", "kpi")
PARAMETER_WORDS = ("param", "slicer")
EXCEL_WORDS, CSV_WORDS, WEB_WORDS = ("excel.workbook", ".xls"), ("csv.document", ".csv"), ("web.contents", "https://", "http://")
POSTING_WORDS = ("date", "fecha", "posting")
COUNT_WORDS = ("amt", "amount", "qty", "quantity", "count", "total")
RATE_WORDS = ("price", "rate", "pct", "percent")
DAY_WORDS = ("date", "fecha", "posting", "month", "day")
#: The order that ties take.
CLASSES = ("FACT", "DIMENSION", "BRIDGE", "CALCULATION", "PARAMETER")


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def first_of(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def is_key(name: Column, source: Column | None = None) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", name, *([] if source is None else [source]))), KEY_PARTS)


def semantic_role(name: Column, data_type: Column, key: Column, category: Column | None = None) -> Column:
    low, kind = F.lower(name), F.lower(data_type)
    place = F.lit(False) if category is None else F.coalesce(F.lower(category).isin(*GEOGRAPHY), F.lit(False))
    return first_of(
        [
            (key, "KEY"),
            (kind.isin("datetime", "date") | contains_any(low, DATE_WORDS), "DATE"),
            (kind.isin(*NUMERIC_TYPES), "NUMERIC"),
            (place, "GEOGRAPHY"),
            (contains_any(low, TEXT_WORDS), "ATTRIBUTE"),
            (kind == "boolean", "FLAG"),
        ],
        "ATTRIBUTE",
    )


def has_calculated_signal(content: Column) -> Column:
    return contains_any(F.upper(content), CALCULATED_SIGNALS)


def table_kind(name: Column, columns: Column, measures: Column, partitions: Column, datatable: Column, calculated: Column) -> Column:
    low = F.lower(name)
    return first_of(
        [
            ((measures > 0) & (columns <= 1), "CALCULATION"),
            (contains_any(low, CALCULATION_WORDS) & (measures > 0), "CALCULATION"),
            (datatable & (columns <= 5), "PARAMETER"),
            (contains_any(low, PARAMETER_WORDS), "PARAMETER"),
            (calculated, "CALCULATED_TABLE"),
            (partitions > 0, "MODEL_TABLE"),
        ],
        "UNKNOWN",
    )


def partition_source(block: Column) -> Column:
    up, low = F.upper(block), F.lower(block)
    return first_of(
        [
            (up.contains("DATATABLE"), "DATATABLE"),
            (up.contains("SQL"), "SQL"),
            (contains_any(low, EXCEL_WORDS), "Excel"),
            (contains_any(low, CSV_WORDS), "CSV/Text"),
            (up.contains("SHAREPOINT"), "SharePoint"),
            (contains_any(low, WEB_WORDS), "Web"),
            (low.contains("let") & low.contains("in"), "Power Query"),
        ],
        "Unknown",
    )


def keyword_type(text: Column) -> Column:
    low = F.lower(text)
    return first_of([(contains_any(low, words), kind) for kind, words in KEYWORDS.items()] + [(low.contains("database"), "Database")], "Other")


def connector_type(connector: Column, text: Column) -> Column:
    low = F.lower(connector)
    by_name = [(low.isin(*(n.lower() for n in names)), kind) for kind, names in CONNECTORS.items()]
    return first_of(by_name, keyword_type(text))


def connector_confidence(connector: Column, text: Column) -> Column:
    known = [n.lower() for names in CONNECTORS.values() for n in names]
    kind = keyword_type(text)
    return first_of([(F.lower(connector).isin(*known), 0.95), (kind == "Database", 0.55), (kind == "Other", 0.30)], 0.70)


def privacy_note(kind: Column) -> Column:
    return first_of(
        [
            (kind.isin(*WEB_TYPES), "Web source: check sign-in and privacy level."),
            (kind.isin(*FILE_TYPES), "File source: check that the path is reachable on refresh."),
            (kind.isin(*DATABASE_TYPES), "Database source: check gateway and credentials."),
        ]
    )


def visual_category(visual_type: Column) -> Column:
    return first_of([(visual_type.isin(*names), category) for category, names in VISUALS.items()], "OTHER")


def display_type(name: Column, data_type: Column) -> Column:
    low = F.lower(name)
    return first_of(
        [
            (name.contains(" = "), "Calculated Column"),
            (data_type == "string", "Text"),
            (data_type.isin("int64", "int", "integer"), "Whole Number"),
            (data_type.isin("double", "real", "float", "decimal"), "Decimal Number"),
            (data_type.isin("dateTime", "date"), F.when(contains_any(low, POSTING_WORDS), "Date").otherwise("DateTime")),
            (data_type == "boolean", "True/False"),
            (data_type == "binary", "Binary"),
            (contains_any(low, COUNT_WORDS), "Whole Number"),
            (contains_any(low, RATE_WORDS), "Decimal Number"),
            (contains_any(low, DAY_WORDS), "Date"),
        ],
        F.concat(F.lit("Other ("), data_type, F.lit(")")),
    )


def confidence(best: Column, total: Column) -> Column:
    base = F.when(best >= 70, 0.9).when(best >= 50, 0.8).when(best >= 30, 0.65).when(best >= 15, 0.5).otherwise(0.35)
    mean = (base + F.try_divide(best.cast("double"), total.cast("double"))) / 2
    return F.when(total <= 0, F.lit(0.3)).otherwise(F.bround(F.greatest(F.lit(0.3), F.least(F.lit(0.98), mean)), 2))


def grade(score: Column, grades: dict[str, int] | None = None) -> Column:
    """The first grade whose least score is reached; the last one if none is."""
    least = grades or GRADES
    return first_of([(score >= v, k) for k, v in list(least.items())[:-1]], list(least)[-1])


def status(score: Column) -> Column:
    return grade(score, STATES)


def dominant_visual(charts: Column, tables: Column, cards: Column) -> Column:
    most = F.greatest(charts, tables, cards)
    return F.when(most == 0, "NONE").when(charts == most, "CHART").when(tables == most, "TABLE").otherwise("CARD")


def is_internal_table(name: Column) -> Column:
    return name.rlike("^(DateTableTemplate_|LocalDateTable_)")
