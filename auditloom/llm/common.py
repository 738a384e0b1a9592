"""Shared helpers: the shared folder, cut lineage, Arrow batches and text hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time: what it needs stays in the CPU's cache.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch at most: what a Python worker and its buffer in the executor hold of the input at a time.
BATCH_BYTES = 4 << 20
#: A table is broadcast only up to this many cells (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster has none to guess."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="auditloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """The tables that one run writes to the shared folder, in a folder of its own: it goes when Python ends, single tables earlier."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        atexit.register(_remove, spark, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: lineage ends there, lost executors cost nothing."""
        path = f"{self.root}/{name}-{len(self.paths.setdefault(name, []))}"
        self.paths[name].append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            for path in self.paths.pop(name, []):
                _remove(self.spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` by the file system that holds it; when the JVM is gone already, nothing can be done."""
    context = spark.sparkContext
    try:
        conf = context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    except (Py4JError, AttributeError, OSError):
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a folder of its own and read it back."""
    return Scratch(df.sparkSession, name).table(df, name)


def fresh_names(*names: str) -> list[str]:
    """Column names that no table has."""
    mark = uuid.uuid4().hex
    return [f"{name}-{mark}" for name in names]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi_by_size(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (distinct rows); broadcast only if the count allows it."""
    return join_by_size(df, ids, [key], "left_semi")


def join_by_size(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """``df`` joined with ``small``, which is broadcast only if it has few cells; beyond that both are shuffled and hot keys of ``df`` are split.

    ``small`` should be a written table: its rows are counted, and a join with it alone can be split.
    """
    limit = BROADCAST_ROWS // len(small.columns)
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    if not null_safe:
        return df.join(small, on, how)
    return df.join(small, reduce(lambda a, b: a & b, (df[c].eqNullSafe(small[c]) for c in on)), how)


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 4 * CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) pieces of about ``limit`` characters; null texts are empty."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` where ``work`` yields dicts of columns for each batch; ``finish`` is called after a partition's last one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in work(batch):
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x := out[f.name], (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, f.type) for f in arrow],
                        schema=arrow,
                    )
        if finish:
            finish()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, fields)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless its bound is lower already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or ""
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


# Polynomial hashing modulo 2**64 over bytes: the hash of any slice comes from two prefix sums.

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (in place where it can)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    steps = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_BASE)
    return mix64(steps)


class ByteHash:
    """Prefix sums over one byte array; ``slices`` hashes any of its ranges at once."""

    _powers: np.ndarray | None = None
    _inverse: np.ndarray | None = None

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._powers is None or len(cls._powers) < n:
            size = max(n, 2 * CHUNK_BYTES)
            ones = np.ones(1, np.uint64)
            cls._powers = np.cumprod(np.concatenate([ones, np.full(size, _BASE, np.uint64)]))
            cls._inverse = np.cumprod(np.concatenate([ones, np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)]))
        return cls._powers, cls._inverse

    def __init__(self, data: np.ndarray, seed: int = 11):
        table = splitmix(seed, 256) | np.uint64(1)
        powers, self.inverse = self._tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers[: len(data)], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z lower-cased, and each text's first word (n + 1 offsets)."""
    raw = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    bounds = np.cumsum([len(x) + 1 for x in raw])
    word = np.zeros(len(data) + 1, bool)
    word[1:] = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    hashes = ByteHash(data).slices(start, end)
    return hashes, np.concatenate([[0], np.searchsorted(start, bounds)])


def shingle_sets(texts: list[str], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: ``width`` words in a row, the whole sequence if it has fewer."""
    hashes, offsets = word_hashes(texts)
    factors = splitmix(101, width) | np.uint64(1)
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += hashes[k : k + n] * factors[k]
    rolled = mix64(rolled)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix64(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
