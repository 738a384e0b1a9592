"""The block splitter: text to rows, as an Arrow map over files and as a table function for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import dealt, small_batches

#: What starts an object of a definition.
KEYWORDS = ("table", "column", "measure", "hierarchy", "level", "partition", "annotation", "relationship", "calculationGroup", "calculationItem")
#: The kinds that are found.
KINDS = ("table", "column", "measure", "partition", "relationship")
#: Those that relations are made of; the block of a table is all of its file, which is read as a file.
PARTS = ("column", "measure", "partition", "relationship")
#: Characters that a task takes from a file, and of found objects that it gives back, at a time.
PART = 1 << 20
#: Properties of a measure that end its expression.
MEASURE_KEYS = ("formatString", "displayFolder", "description", "lineageTag", "isHidden", "hidden", "dataCategory", "detailRowsDefinition", "kpi", "annotation", "changedProperty", "extendedProperty")


def indent(line: str) -> int:
    """Leading white space, a tab counting four."""
    wide = line.replace("\t", "    ")
    return len(wide) - len(wide.lstrip())


def starts_object(text: str) -> bool:
    head, _, rest = text.partition(" ")
    return bool(rest or text.endswith(" ")) and head in KEYWORDS


def split_blocks(content: str, kind: str) -> Iterator[tuple[str, str, int]]:
    """(header, block, line) of each object of ``kind``: up to the next object that is not indented deeper; line counts from 1."""
    opener = kind + " "
    current: tuple[str, int, int] | None = None
    body: list[str] = []
    for number, line in enumerate(content.splitlines(), 1):
        text = line.strip()
        if current and text and indent(line) <= current[1] and starts_object(text):
            yield current[0], "\n".join(body), current[2]
            current, body = None, []
        if current is None:
            if text.startswith(opener):
                current = text[len(opener) :].strip(), indent(line), number
        else:
            body.append(line)
    if current:
        yield current[0], "\n".join(body), current[2]


def measure_body(header: str, block: str) -> str | None:
    """The expression of a measure: on its header line, between fences, or in the lines below up to the first property."""
    _, equals, inline = header.partition("=")
    if "```" in inline or (not inline.strip() and block.lstrip().startswith("```")):
        text = inline + "\n" + block
        return text.split("```")[1] if text.count("```") >= 1 else None
    if inline.strip():
        return inline.strip()
    if not equals:
        return None
    lines = []
    for line in block.split("\n"):
        word = line.strip().split(":")[0].split(" ")[0]
        if word in MEASURE_KEYS:
            break
        lines.append(line)
    return "\n".join(lines).strip() or None


def _lines(content: str) -> Iterator[str]:
    """``content.splitlines()``, a part at a time."""
    at = 0
    while at < len(content):
        end = content.find("\n", at + PART) + 1 or len(content)
        yield from content[at:end].splitlines()
        at = end


def split_kinds(content: str, kinds: tuple[str, ...]) -> Iterator[tuple[str, str, str, int]]:
    """(kind, header, block, line) of the objects of several kinds, each as ``split_blocks`` has it, in one pass: only open blocks are held."""
    open_: dict[str, tuple[str, int, int, list[str]]] = {}
    for number, line in enumerate(_lines(content), 1):
        text = line.strip()
        head, _, rest = text.partition(" ")
        started = None
        if rest and (head in KEYWORDS or head in kinds):
            depth = indent(line)
            if head in KEYWORDS:
                for kind in [k for k, x in open_.items() if depth <= x[1]]:
                    header, _, first, body = open_.pop(kind)
                    yield kind, header, "\n".join(body), first
            if head in kinds and head not in open_:
                started = head
                open_[head] = rest.strip(), depth, number, []
        for kind, x in open_.items():
            if kind != started:
                x[3].append(line)
    for kind, (header, _, first, body) in open_.items():
        yield kind, header, "\n".join(body), first


def objects(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """project, rel_path, file_stem, kind, header, block, line, body of all objects of all files, in one pass.

    A null content has no objects. ``body`` is the expression of a measure. A task holds one file
    and what it has found since its last batch, of ``PART`` characters or so.
    """
    fields = StructType.fromDDL("project string, rel_path string, file_stem string, kind string, header string, block string, line int, body string")
    schema = to_arrow_schema(fields)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                project, path, stem, content = (batch.column(c)[i].as_py() for c in ("project", "rel_path", "file_stem", "content"))
                for kind, header, block, line in split_kinds(content or "", kinds):
                    rows.append((project, path, stem, kind, header, block, line, measure_body(header, block) if kind == "measure" else None))
                    size += len(header) + len(block) + 100
                    if size > PART:
                        yield made(rows)
                        rows, size = [], 0
        yield made(rows)

    small_batches(files.sparkSession)
    return files.select("project", "rel_path", "file_stem", "content").mapInArrow(run, fields)


def dealt_objects(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``objects`` over all cores: what is read from each of them costs more than finding it, and a large file has many."""
    return dealt(objects(files, kinds), "project", "rel_path", "kind", "line")


def register_blocks(spark: SparkSession) -> None:
    """``tmdl_blocks(content, kind)`` for use in SQL by LATERAL."""

    class Blocks:
        def eval(self, content: str, kind: str):
            yield from split_blocks(content or "", kind)

    spark.udtf.register("tmdl_blocks", F.udtf(Blocks, returnType="header string, block string, line int"))


def line_blocks(texts: DataFrame, key: str, text: str, opener: str) -> DataFrame:
    """The native form for plain text: lines that match ``opener`` start blocks; key, block_no, start_line, n_lines, n_chars.

    Lines before the first opener are block 0. Blocks are numbered by a running count over the lines of a row.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block_no", F.sum(F.col("line").rlike(opener).cast("int")).over(order))
    return numbered.groupBy(key, "block_no").agg(F.min("pos").alias("first"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars")).select(
        key, F.col("block_no").cast("long").alias("block_no"), (F.col("first") + 1).cast("long").alias("start_line"), "n_lines", F.col("n_chars").cast("long").alias("n_chars")
    )
