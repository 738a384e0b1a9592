"""Projects dropped into a folder, audited as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..plans import audit
from ..sources import model_files
from ..sources.sinks import write_relations
from ..sources.tmdl import _root, definitions, project_name, reports

_SEEN = f"{model_files.SCHEMA}, batch long"


def changed_files(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of a listing that no earlier one has: new files, and files of another time or length."""
    return found.join(seen, ["path", "modified", "length"], "left_anti")


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Audit every project that new or changed files belong to, whole, and write its relations; restarts go on from ``checkpoint``.

    Each trigger lists ``root`` on the executors, files that start with an underscore included. What a
    batch has seen first is kept below ``checkpoint``; a batch that runs again writes the same.
    Only files of changed projects are opened.
    """

    def batch(found: DataFrame, number: int) -> None:
        log = f"{checkpoint}/seen"
        jvm = spark._jvm.org.apache.hadoop.fs.Path(log)
        there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
        seen = (spark.read.schema(_SEEN).parquet(log) if there else spark.createDataFrame([], _SEEN)).where(F.col("batch") < number)
        listing = found.persist()
        try:
            changed_files(listing, seen).write.mode("overwrite").parquet(f"{log}/batch={number}")
            project = project_name(F.col("path"))
            changed = spark.read.schema(model_files.SCHEMA).parquet(f"{log}/batch={number}").select(project.alias("project")).distinct()
            if not changed.limit(1).count():
                return
            own = listing.withColumn("project", project).join(changed, "project", "left_semi")
            is_report = F.col("path").endswith(".json")
            files, report = (model_files.contents(own.where(c)) for c in (~is_report, is_report))
            with audit.relations(definitions(files), reports(report)) as r:
                write_relations(r, f"{out}/batch={number}")
        finally:
            listing.unpersist()

    stream = model_files.listings(spark, _root(spark, root))
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
