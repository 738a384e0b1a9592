"""Files in pieces give the blocks of whole files."""

import random

from pyspark.sql import functions as F

from auditloom.operators import blocks, pieces
from auditloom.sources import model_files


def text_of(seed, n):
    random.seed(seed)
    words = ["table T", "column 'A b'", "measure M = SUM(x)", "measure N =", "partition p = m", "annotation x = y", "dataType: int64", "", "  ", "VAR a = 1", "hierarchy H", "level L", "relationship r", "Übung", "column", "measures"]
    return "".join("\t" * random.randrange(4) + random.choice(words) + random.choice(["", "", " 1"]) + random.choice(["\n", "\n", "\r\n"]) for _ in range(n)) + random.choice(["", "column last"])


def test_cuts_are_whole_lines(tmp_path):
    for seed in range(6):
        raw = text_of(seed, 60).encode()
        path = tmp_path / f"f{seed}.tmdl"
        path.write_bytes(raw)
        for size in (1, 3, 17, 100, 10_000):
            got = [pieces.cut(str(path), at, at + size) for at in range(0, len(raw), size)]
            assert b"".join(got) == raw and all(x.endswith(b"\n") for x in got[:-1] if x and b"".join(got[got.index(x) + 1 :]))


def test_blocks_of_pieces_equal_those_of_whole_files(spark, tmp_path):
    texts = {f"f{seed}.tmdl": text_of(seed, 150) for seed in range(8)} | {"empty.tmdl": "", "deep.tmdl": "\tmeasure A = 1\n" + "\t\tx\n" * 300 + "\tmeasure B = 2\n"}
    folder = tmp_path / "P.SemanticModel/definition"
    folder.mkdir(parents=True)
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    listed = model_files.listing(spark, str(tmp_path), "definition", slots=2)
    for size in (64, 400):
        cut = pieces.read_pieces(listed, size).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
        got = pieces.blocks_of_pieces(cut).collect()
        found = sorted(((r["path"], r["kind"], r["line"], r["header"], r["block"], r["body"]) for r in got), key=str)
        want = sorted(((name, kind, line, header, block, blocks.measure_body(header, block) if kind == "measure" else None) for name, text in texts.items() for kind in blocks.KINDS for header, block, line in blocks.split_blocks(text, kind)), key=str)
        assert found == want
        assert cut.select("path", "piece").distinct().count() > 3 * len(texts)
