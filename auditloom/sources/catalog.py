"""A catalogue of parquet tables as model relations: tables, typed columns and declared edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Declared foreign keys: from table and column (many), to table and column (one).
EDGES = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)
_MODEL_TYPES = ((T.IntegerType, "int32"), (T.LongType, "int64"), (T.DoubleType, "double"), (T.StringType, "string"), (T.TimestampType, "dateTime"), (T.TimestampNTZType, "dateTime"), (T.BooleanType, "boolean"))


def model_type(kind: T.DataType) -> str:
    return next((name for cls, name in _MODEL_TYPES if isinstance(kind, cls)), "other")


def read_columns(spark: SparkSession, sf_dir: str, project: str = "catalog") -> DataFrame:
    """project, table, name, data_type, ordinal, summarize_by, is_calculated, is_hidden: from the files' schemas, no data is read.

    Numeric columns that are no keys are summed.
    """
    keys = {(a, b) for a, b, *_ in EDGES} | {(c, d) for *_, c, d in EDGES}
    rows = []
    for table in TABLES:
        for i, f in enumerate(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema, 1):
            kind = model_type(f.dataType)
            summed = kind in ("int32", "int64", "double") and (table, f.name) not in keys and "key" not in f.name and "_id" not in f.name
            rows.append((project, table, f.name, kind, i, "sum" if summed else "none", False, False))
    return spark.createDataFrame(rows, "project string, table string, name string, data_type string, ordinal int, summarize_by string, is_calculated boolean, is_hidden boolean")


def read_edges(spark: SparkSession, project: str = "catalog") -> DataFrame:
    """The declared edges as relationships."""
    rows = [(project, *e, "many", "one", "Single", True) for e in EDGES]
    return spark.createDataFrame(rows, "project string, from_table string, from_column string, to_table string, to_column string, from_cardinality string, to_cardinality string, cross_filter_direction string, is_active boolean")
