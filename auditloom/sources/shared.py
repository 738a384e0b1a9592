"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own, as in tests; a cluster has none to guess."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="auditloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of an Arrow batch at most: what a Python worker holds of its input at a time, if a row has not more.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless its bound is lower already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or ""
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over all cores by ``keys``, for work that costs more than reading: small files, or groups that shrink in a shuffle, would be few tasks, however many rows they have."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


class Run:
    """A folder of one run in the shared folder, for tables that later plans start from; it goes with ``close``, or when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back: later plans start from the table, not from its history."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the folder; its tables cannot be read any more. When the JVM is gone already, nothing can be done."""
        atexit.unregister(self.close)
        context = self.spark.sparkContext
        try:
            conf = context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()
            place = context._jvm.org.apache.hadoop.fs.Path(self.root)
            place.getFileSystem(conf).delete(place, True)
        except (Py4JError, AttributeError, OSError):
            pass
