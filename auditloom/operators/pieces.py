"""Blocks of definition files that are larger than a task should hold.

A file is cut into pieces of whole lines, read by byte ranges. Whether a block is open where
a piece begins depends on all pieces before it; so each piece is described by what it
makes of an open block of any indent: the lines that would end it, from the least deep
on (a few: each is less deep than those before), and the block that is open at
the end if the scan goes on from there. These are carried from piece to piece,
and then every piece is split on its own. The parts of a block are joined by where it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.model_files import opened
from .blocks import KINDS, indent, measure_body, starts_object

PIECE_BYTES = 16 << 20
#: Bytes that are read at a time to find the end of a piece's last line.
STEP = 1 << 16
_DESCRIBED = "path string, kind string, piece long, lines long, steps array<struct<depth:long,line:long,indent:long>>"
_PARTS = "path string, kind string, of_piece long, of_line long, piece long, header string, text string"


def cut(path: str, start: int, end: int) -> bytes:
    """The lines of a file that begin in the byte range ``start`` to ``end``, whole."""
    store, name = opened(path)
    with store.open_input_file(name) as file:
        size = file.size()
        if start:
            file.seek(start - 1)  # a line begins here only behind a line end
        raw = file.read(end - max(start - 1, 0))
        while file.tell() < size and not raw.endswith(b"\n"):
            more = file.read(STEP)
            at = more.find(b"\n")
            raw += more if at < 0 else more[: at + 1]
            if at >= 0:
                break
    if start:
        at = raw.find(b"\n")
        # no line begins in this range
        if at < 0 or start + at >= end:
            return b""
        raw = raw[at + 1 :]
    return raw


def read_pieces(files: DataFrame, size: int = PIECE_BYTES) -> DataFrame:
    """path, piece and content of listed files (path, length), a row for each ``size`` bytes."""
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    schema = pa.schema([("path", pa.string()), ("piece", pa.int64()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                text = cut(path, start, start + size).decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start // size]), pa.array([text])], schema=schema)

    return ranges.repartition("path", "start").mapInArrow(run, "path string, piece long, content string")


def _scan(lines: list[str], kind: str, depth: int | None, begin: int = 0) -> Iterator[tuple[int | None, int, int, int | None]]:
    """(line of the header, or None for the block that is open at ``begin`` with indent ``depth``; first and last line of the body; its indent if it is open at the end)."""
    opener, head, first = kind + " ", None, begin
    for number in range(begin, len(lines)):
        text = lines[number].strip()
        if depth is not None and text and indent(lines[number]) <= depth and starts_object(text):
            yield head, first, number, None
            depth = None
        if depth is None and text.startswith(opener):
            head, first, depth = number, number + 1, indent(lines[number])
    if depth is not None:
        yield head, first, len(lines), depth


def _open_after(lines: list[str], kind: str, begin: int) -> tuple[int, int] | None:
    """(line, indent) of the block that is open at the end, if none is at ``begin``."""
    last = None
    for last in _scan(lines, kind, None, begin):
        pass
    return (last[0], last[3]) if last and last[3] is not None else None


def describe(content: str, kind: str) -> list[tuple[int, int, int]]:
    """(indent, line, indent of it): an open block at least so deep ends here, and that block is open at the end (-1: none). The first one is of no open block (indent -1)."""
    lines = content.splitlines()
    out = [(-1, *(_open_after(lines, kind, 0) or (-1, -1)))]
    least = 1 << 30
    for number, line in enumerate(lines):
        text = line.strip()
        if text and indent(line) < least and starts_object(text):
            least = indent(line)
            out.append((least, *(_open_after(lines, kind, number) or (-1, -1))))
    return out


def _carried(described: DataFrame) -> DataFrame:
    """path, kind, piece, and the block that is open where it begins: piece and line of its header, and its indent (-1: none)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        open_, rows = None, []
        for piece, steps in zip(pdf["piece"], pdf["steps"], strict=True):
            rows.append(open_ or (-1, -1, -1))
            ends = [x for x in steps if (x["depth"] == -1 if open_ is None else 0 <= x["depth"] <= open_[2])]
            if ends:
                first = ends[0]
                open_ = (piece, first["line"], first["indent"]) if first["line"] >= 0 else None
        return pd.DataFrame({"path": pdf["path"], "kind": pdf["kind"], "piece": pdf["piece"], "of_piece": [x[0] for x in rows], "of_line": [x[1] for x in rows], "indent": [x[2] for x in rows]})

    return described.groupBy("path", "kind").applyInPandas(run, "path string, kind string, piece long, of_piece long, of_line long, indent long")


def blocks_of_pieces(pieces: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """path, kind, header, block, line and body of all objects of files in pieces (path, piece, content): what ``blocks.objects`` finds in whole files."""

    described_schema, parts_schema = (to_arrow_schema(StructType.fromDDL(x)) for x in (_DESCRIBED, _PARTS))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, piece, content in zip(*(batch.column(c).to_pylist() for c in ("path", "piece", "content")), strict=True):
                steps = [[{"depth": a, "line": b, "indent": c} for a, b, c in describe(content or "", k)] for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([path] * len(kinds), kinds, [piece] * len(kinds), [len((content or "").splitlines())] * len(kinds), steps), described_schema, strict=True)], schema=described_schema)

    described = pieces.select("path", "piece", "content").mapInArrow(summary, _DESCRIBED)
    carried = _carried(described).groupBy("path", "piece").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("of_piece", "of_line", "indent")))).alias("open"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, piece, content, open_ in zip(*(batch.column(c).to_pylist() for c in ("path", "piece", "content", "open")), strict=True):
                lines, open_ = (content or "").splitlines(), dict(open_)
                for kind in kinds:
                    own = open_[kind]
                    for head, first, last, _ in _scan(lines, kind, own["indent"] if own["indent"] >= 0 else None):
                        place = (own["of_piece"], own["of_line"]) if head is None else (piece, head)
                        header = None if head is None else lines[head].strip()[len(kind) + 1 :].strip()
                        if head is not None or last > first:
                            rows.append((path, kind, *place, piece, header, "\n".join(lines[first:last]) if last > first else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), parts_schema, strict=True)] if rows else [pa.array([], f.type) for f in parts_schema], schema=parts_schema)

    parts = pieces.select("path", "piece", "content").join(carried, ["path", "piece"]).mapInArrow(split, _PARTS)
    joined = parts.groupBy("path", "kind", "of_piece", "of_line").agg(F.max("header").alias("header"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("piece", "text")))), lambda x: x["text"]), "\n").alias("block"))
    counts = described.where(F.col("kind") == kinds[0]).select("path", F.col("piece").alias("of_piece"), "lines")
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("of_piece").rowsBetween(Window.unboundedPreceding, -1))
    numbered = joined.join(counts.withColumn("before", F.coalesce(before, F.lit(0))), ["path", "of_piece"])
    body = F.udf(lambda header, block: measure_body(header, block), "string", useArrow=True)
    return numbered.select("path", "kind", "header", "block", (F.col("before") + F.col("of_line") + 1).cast("int").alias("line"), F.when(F.col("kind") == "measure", body("header", "block")).alias("body"))
