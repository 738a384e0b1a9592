"""The data source ``model_files``: files of model projects, listed on the executors, as a table and as a stream.

    spark.dataSource.register(ModelFiles)
    spark.read.format("model_files").option("kind", "definition").load(root)

Its partitions are slots. Each slot lists the folders near the root itself, level by level,
until there are some for every slot, and goes down into those whose path hashes to it; so
every other folder is listed once, by one task, and the driver lists nothing. Only
folders that can hold files of the asked kind are entered, and no file is opened here.

As a stream, each trigger lists anew: what has changed is for its reader to tell
from earlier listings (``streaming.watch``).
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Slots, and how many folders for each slot are enough to stop listing in all of them.
SLOTS, FOLDERS = 32, 4
#: Bytes of content in one batch, about.
BATCH_BYTES = 4 << 20
SCHEMA = "path string, modified timestamp, length long"
#: What a project's folders are called.
MODEL, REPORT, PROJECT = ".SemanticModel", ".Report", ".pbip"
KINDS = ("definition", "report", "files", "projects")


def opened(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _enters(kind: str, folder: str) -> bool:
    """Whether files of ``kind`` can lie in ``folder``."""
    parent, _, name = folder.rpartition("/")
    above = parent.rpartition("/")[2]
    if name.startswith("."):
        return False
    if kind == "projects":
        return not name.endswith((MODEL, REPORT))
    if name.endswith(REPORT) and kind == "definition" or name.endswith(MODEL) and kind == "report":
        return False
    return name == "definition" or not above.endswith((MODEL, REPORT))


def _wanted(kind: str, path: str) -> bool:
    definition = path.endswith(".tmdl") and "/definition/" in path
    report = path.endswith(".json") and REPORT + "/definition/pages/" in path
    return definition and kind != "report" or report and kind != "definition"


class _Slot(InputPartition):
    def __init__(self, slot: int, slots: int):
        super().__init__((slot, slots))
        self.slot, self.slots = slot, slots


def walk(root: str, kind: str, slot: int = 0, slots: int = 1) -> Iterator[tuple]:
    """(path, modified, length) of one slot's files; of its folders that are named as projects, for kind ``projects``."""
    from pyarrow import fs

    store, top = opened(root)
    prefix = root.rstrip("/").removesuffix(top.rstrip("/")) if "://" in root else "file:"
    mine = lambda path: zlib.crc32(path.encode("utf-8", "surrogatepass")) % slots == slot

    def listed(folder: str) -> Iterator:
        return iter(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))

    def rows(info: object) -> Iterator[tuple]:
        folder = info.type == fs.FileType.Directory
        if kind == "projects" and folder and info.base_name.endswith((MODEL, PROJECT)) or kind != "projects" and not folder and _wanted(kind, info.path):
            yield prefix + info.path, (info.mtime_ns or 0) // 1000, 0 if folder else info.size

    level = [top]
    while level and len(level) < FOLDERS * slots or level == [top]:  # in all slots alike
        after = []
        for folder in level:
            for info in listed(folder):
                if mine(info.path):
                    yield from rows(info)
                if info.type == fs.FileType.Directory and _enters(kind, info.path):
                    after.append(info.path)
        level = after
    own = [x for x in level if mine(x)]
    while own:
        for info in listed(own.pop()):
            yield from rows(info)
            if info.type == fs.FileType.Directory and _enters(kind, info.path):
                own.append(info.path)


class _Listing:
    def __init__(self, options: dict):
        self.root, self.kind, self.slots = options["path"], options.get("kind", "files"), int(options.get("slots", SLOTS))
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    def slot_partitions(self) -> list[InputPartition]:
        return [_Slot(k, self.slots) for k in range(self.slots)]

    def read(self, partition: _Slot) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.timestamp("us", "UTC"), pa.int64())
        held: list[tuple] = []
        found = walk(self.root, self.kind, partition.slot, partition.slots)
        while True:
            held = [x for x, _ in zip(found, range(10_000), strict=False)]
            if not held:
                return
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in enumerate(types)], names=["path", "modified", "length"])


class _Reader(_Listing, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.slot_partitions()


class _Stream(_Listing, DataSourceStreamReader):
    """Offsets are times: each trigger is a listing."""

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.slot_partitions()


class ModelFiles(DataSource):
    """Options: path (of ``load``), kind (definition, report, files: both, projects: folders named as one), slots."""

    @classmethod
    def name(cls) -> str:
        return "model_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def listing(spark: SparkSession, root: str, kind: str = "files", slots: int | None = None) -> DataFrame:
    """path, modified and length of the files of ``kind`` under ``root``."""
    spark.dataSource.register(ModelFiles)
    return spark.read.format("model_files").option("kind", kind).option("slots", slots or SLOTS).load(root)


def listings(spark: SparkSession, root: str, kind: str = "files", slots: int | None = None) -> DataFrame:
    """The same as a stream of whole listings, one a trigger."""
    spark.dataSource.register(ModelFiles)
    return spark.readStream.format("model_files").option("kind", kind).option("slots", slots or SLOTS).load(root)


def contents(files: DataFrame) -> DataFrame:
    """path and content of listed files, read on the executors and dealt out anew; a file that is gone meanwhile is left out."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, texts, size = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = opened(path)
                try:
                    with store.open_input_stream(name, compression=None) as stream:
                        texts.append(stream.read())
                except FileNotFoundError:
                    continue
                paths.append(path)
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], schema=schema)
                    paths, texts, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], schema=schema)

    return files.select("path").repartition("path").mapInArrow(run, "path string, content binary")
