import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, doc int, key string, row int, hash string, copies int, spans string, n int"


def frame(spark, rows):
    """Documents (doc_id, text, source) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", 1, "x", 1, "x", 1, "x", 1) for i, t, s in rows], SCHEMA)


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30000))
BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word60 ", "other ")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, short and very long texts, repeated rows, copies."""
    return frame(spark, [
        (1, BASE, "a"), (2, NEAR, "a"), (3, BASE, "b"), (3, BASE, "b"), (4, "", "b"), (5, None, None), (None, BASE, "a"), (None, None, None),
        (6, LONG, "c"), (7, LONG + " tail", "c"), (8, "one two", "a"), (9, "ONE  two", "a"), (10, " \t\n", "z"), (11, "Mail me@x.org or token = abcdefgh12", "a"), (12, "é" * 5000, "é"),
    ])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
