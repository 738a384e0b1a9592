"""Writers: relations by project, and documents as text files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_relations(relations: Mapping[str, DataFrame], root: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Each relation in a folder of its own, partitioned by project where it has one."""
    for name, df in relations.items():
        writer = df.write.mode(mode).format(fmt)
        (writer.partitionBy("project") if "project" in df.columns and len(df.columns) > 1 else writer).save(f"{root}/{name}")


def assembled(lines: DataFrame) -> DataFrame:
    """project, document, text: the ordered lines of each document joined."""
    rows = lines.groupBy("project", "document").agg(F.sort_array(F.collect_list(F.struct("section_no", "line_no", "line"))).alias("rows"))
    return rows.select("project", "document", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def write_documents(lines: DataFrame, root: str) -> DataFrame:
    """One Markdown file for each project and document, written by the executors to any store that Spark knows; project, document and path of each.

    Spark's text writer makes a folder a document, ``<root>/project=<p>/document=<d>``, with one file in it: lines of a document are one partition's.
    """
    rows = assembled(lines).select("project", "document", "text")
    rows.repartition("project", "document").write.mode("overwrite").partitionBy("project", "document").text(root)
    return rows.select("project", "document", F.concat(F.lit(root.rstrip("/") + "/project="), "project", F.lit("/document="), "document").alias("path"))


def read_relations(spark: SparkSession, root: str, schemas: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Relations that ``write_relations`` wrote as JSON, by name. ``schemas``: relations whose types to read them with; a missing one is empty then, else left out."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    store = hadoop.Path(root).getFileSystem(conf)
    there = {s.getPath().getName() for s in store.listStatus(hadoop.Path(root)) if s.isDirectory()}
    out = {}
    for name in sorted(there if schemas is None else schemas):
        if schemas is None:
            out[name] = spark.read.json(f"{root}/{name}")
        elif name in there:
            out[name] = spark.read.schema(schemas[name].schema).json(f"{root}/{name}")
        else:
            out[name] = spark.createDataFrame([], schemas[name].schema)
    return out


def as_list(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Rows (``schema``) of JSON files that hold a list of objects, or an object with the list under ``key``; files that are neither give none."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", f"$.{key}", "array<variant>"))
    return text.select(F.explode(items).alias("item")).select(F.from_json(F.to_json("item"), schema).alias("row")).select("row.*")
