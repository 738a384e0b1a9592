"""Readers of model projects: definition text, report JSON and their places.

One scan reads every definition file of every project under a root; projects
are a column, so a batch is one job. Files are small: a file is a row.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import valid_text
from . import model_files
from .shared import dealt, ensure_checkpoint_dir


def project_name(path: Column) -> Column:
    """The project of a file: its folder ``<name>.SemanticModel``, ``<name>.Report`` or ``<name>.pbip``, without suffixes."""
    found = F.regexp_extract(path, r"([^/]+?)(?:\.SemanticModel|\.Report|\.pbip)(?:/|$)", 1)
    plain = F.regexp_extract(path, r"([^/]+)/definition/", 1)
    return F.regexp_replace(F.when(found != "", found).otherwise(plain), r"(\.SemanticModel|\.pbip)", "")


#: File systems that Python on the executors opens itself.
_OPENED = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _is_opened(spark: SparkSession, root: str) -> bool:
    """Whether executors can list and open ``root`` themselves; other stores are known to the JVM only."""
    return spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() in _OPENED


def _root(spark: SparkSession, root: str) -> str:
    """``root`` with its scheme, as executors open it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(root)
    uri = place.makeQualified(place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), hadoop.Path("/")).toString()
    return uri.removeprefix("file:") if uri.startswith("file:") else uri


def raw_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """path of the files of ``kind`` (definition or report) under ``root``, and a way to their content: ``contents``."""
    return model_files.listing(spark, _root(spark, root), kind)


def _by_jvm(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path and content of files in a store that only the JVM knows. Spark's reader takes names with a leading underscore for hidden: those are listed by the store, one page after another, and read from copies."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").format("binaryFile").load(root)
    raw = raw.select(F.url_decode("path").alias("path"), "content")
    if suffix != ".tmdl":
        return raw
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    store = hadoop.Path(root).getFileSystem(conf)
    every, found = store.listFiles(hadoop.Path(root), True), []
    while every.hasNext():
        place = every.next().getPath()
        if place.getName().startswith("_") and place.getName().endswith(suffix):
            found.append(place)
    return raw.unionByName(_copied(spark, store, found))


def _copied(spark: SparkSession, store: object, found: list) -> DataFrame:
    """path and content of the files ``found`` in ``store``, from copies with plain names in the shared folder."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/copies-{uuid.uuid4().hex}"
    there = hadoop.Path(folder).getFileSystem(conf)
    there.mkdirs(hadoop.Path(folder))

    def copy(item: tuple[int, object]) -> None:
        hadoop.FileUtil.copy(store, item[1], there, hadoop.Path(f"{folder}/{item[0]}.tmdl"), False, conf)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(copy, enumerate(found)))
    names = spark.createDataFrame([(str(i), x.toString()) for i, x in enumerate(found)], "copy string, path string")
    raw = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(folder)
    return raw.select(F.regexp_extract("path", r"([0-9]+)\.tmdl$", 1).alias("copy"), "content").join(names, "copy").select("path", "content")


def definitions(raw: DataFrame) -> DataFrame:
    """project, rel_path, file_stem and content of definition files (path, content); bytes that are not UTF-8 are left out."""
    path = F.col("path")
    return raw.select(
        project_name(path).alias("project"),
        F.regexp_extract(path, r"/definition/(.*)$", 1).alias("rel_path"),
        F.regexp_extract(path, r"([^/]+)\.tmdl$", 1).alias("file_stem"),
        valid_text(F.col("content")).alias("content"),
    ).where("rel_path <> ''")


def reports(raw: DataFrame) -> DataFrame:
    """project, page_id, visual_id (null: the page itself; page_id null: the page list), content of report files (path, content)."""
    place = F.regexp_extract("path", r"/definition/pages/(.*)$", 1)
    pick = lambda pattern: F.when(F.regexp_extract(place, pattern, 1) != "", F.regexp_extract(place, pattern, 1))
    return raw.select(
        project_name(F.col("path")).alias("project"),
        pick(r"^([^/]+)/").alias("page_id"),
        pick(r"^[^/]+/visuals/([^/]+)/visual\.json$").alias("visual_id"),
        valid_text(F.col("content")).alias("content"),
    )


def read_tmdl(spark: SparkSession, root: str, part: str = "") -> DataFrame:
    """``definitions`` of all files under ``root``, or of those whose place in a project starts with ``part``: no others are opened."""
    if not _is_opened(spark, root):
        return definitions(_by_jvm(spark, root, ".tmdl")).where(F.startswith("rel_path", F.lit(part)))
    found = raw_files(spark, root, "definition")
    return definitions(model_files.contents(found.where(F.col("path").contains(f"/definition/{part}"))))


def read_report(spark: SparkSession, root: str) -> DataFrame:
    """``reports`` of all files under ``root``; JSON in other places is not opened."""
    if not _is_opened(spark, root):
        return reports(_by_jvm(spark, root, ".json").where(F.col("path").rlike(r"\.Report/definition/pages/")))
    return reports(model_files.contents(raw_files(spark, root, "report")))


def read_roles(spark: SparkSession, root: str) -> DataFrame:
    """project, role, is_dynamic of each role file (``definition/roles``): dynamic if a filter asks for the user."""
    files = read_tmdl(spark, root, "roles/")
    return files.select("project", F.col("file_stem").alias("role"), F.upper("content").rlike(r"USERPRINCIPALNAME\s*\(|USERNAME\s*\(").alias("is_dynamic"))


def found_projects(spark: SparkSession, root: str) -> DataFrame:
    """project of every folder under ``root`` that is named as one, files in it or not."""
    if not _is_opened(spark, root):
        return _by_jvm(spark, root, ".tmdl").select(project_name(F.col("path")).alias("project")).distinct()
    return raw_files(spark, root, "projects").select(F.regexp_extract("path", r"([^/]+?)(?:\.SemanticModel)?(?:\.pbip)?$", 1).alias("project")).distinct()


def table_files(files: DataFrame) -> DataFrame:
    """The files of tables; a table is named by its file."""
    return files.where(F.col("rel_path").rlike("^tables/")).withColumnRenamed("file_stem", "table")


def source_files(files: DataFrame) -> DataFrame:
    """The files that may name data sources."""
    found = files.where(F.col("file_stem").isin("model", "expressions", "database") | F.col("rel_path").rlike("^tables/"))
    return dealt(found, "project", "rel_path").dropDuplicates(["project", "rel_path"])


def skipped_projects(found: DataFrame, files: DataFrame) -> DataFrame:
    """Projects (column project) without any definition file."""
    return found.join(files.select("project").distinct(), "project", "left_anti")
