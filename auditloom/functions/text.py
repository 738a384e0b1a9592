"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\r\n"


def blank_to_null(c: Column) -> Column:
    return F.when(trimmed(c) != "", c)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def strip_quotes(c: Column) -> Column:
    """Trimmed, without the quotes that enclose it."""
    return F.regexp_replace(trimmed(c), r"(?s)^(['\"])(.*)\1$", "$2")


def collapse(c: Column) -> Column:
    """All white space, Unicode's too, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def preview(c: Column, limit: int = 300) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def header_name(header: Column) -> Column:
    return strip_quotes(F.split(header, "=", 2)[0])


def header_expression(header: Column) -> Column:
    return blank_to_null(trimmed(F.get(F.split(header, "=", 2), F.lit(1))))


def property_text(block: Column, key: str) -> Column:
    """The first ``key: value`` line's value without quotes, or null."""
    found = F.regexp_extract(block, rf"(?m)^[ \t]*{key}:[ \t]*(\S.*?)[ \t\r]*$", 1)
    return blank_to_null(strip_quotes(F.when(block.contains(f"{key}:"), found)))  # most blocks have few of the keys, and lines cost more than a search


def property_flag(block: Column, key: str, default: bool = False) -> Column:
    """``key: true``, or ``key`` alone, as a boolean."""
    value = F.lower(F.regexp_extract(block, rf"(?m)^[ \t]*{key}[ \t]*(?::[ \t]*(\w+))?[ \t\r]*$", 1))
    there = block.contains(key) & block.rlike(rf"(?m)^[ \t]*{key}[ \t]*(:|\r?$)")
    return F.when(~there, F.lit(default)).otherwise((value == "true") | (value == ""))


def properties(block: Column) -> Column:
    """All ``key: value`` lines as a map; the last of one key counts."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*\w+\s*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(trimmed(F.split(x, ":", 2)[0]).alias("k"), strip_quotes(F.split(x, ":", 2)[1]).alias("v")))
    last = lambda found: F.filter(found, lambda p, i: ~F.exists(F.slice(found, i + 2, F.size(found) + 1), lambda q: q["k"] == p["k"]))
    # bound as a variable, the pairs are read once a block, not once a pair
    return F.get(F.transform(F.array(pairs), lambda found: F.map_from_entries(last(found))), F.lit(0))


def fenced(block: Column) -> Column:
    return blank_to_null(F.regexp_extract(block, r"(?s)```(.*?)```", 1))


def clean_column_expression(c: Column) -> Column:
    """Without fences; lines trimmed; runs of blank lines as one."""
    lines = F.regexp_replace(F.regexp_replace(c, "```", ""), r"(?m)^[ \t]+|[ \t\r]+$", "")
    return blank_to_null(F.btrim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \t\r\n")))


def clean_measure_expression(c: Column) -> Column:
    """Without fences, on one line; null if nothing is left."""
    return blank_to_null(collapse(F.regexp_replace(c, r"```|\[MULTILINE\]", " ")))


def annotations(block: Column) -> Column:
    """``annotation N = V`` lines as (name, value); no value is an empty one."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*annotation\s+\S"))
    body = lambda x: F.regexp_replace(x, r"^\s*annotation\s+", "")
    return F.transform(lines, lambda x: F.struct(strip_quotes(F.split(body(x), "=", 2)[0]).alias("name"), F.coalesce(strip_quotes(F.get(F.split(body(x), "=", 2), F.lit(1))), F.lit("")).alias("value")))


def identifier(c: Column) -> Column:
    """Without quotes, then without enclosing brackets."""
    bare = strip_quotes(c)
    return F.regexp_replace(bare, r"^\[(.*)\]$", "$1")


def reference_table(c: Column) -> Column:
    """The table of ``T[C]``, ``'T'.C`` or ``T.C`` (split at the last dot)."""
    bracket = F.regexp_extract(c, r"^\s*(.+?)\s*\[[^\]]*\]\s*$", 1)
    quoted = F.regexp_extract(c, r"^\s*'([^']+)'\s*\.", 1)
    dotted = F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    return blank_to_null(identifier(F.when(bracket != "", bracket).when(quoted != "", quoted).otherwise(dotted)))


def reference_column(c: Column) -> Column:
    bracket = F.regexp_extract(c, r"\[([^\]]*)\]\s*$", 1)
    quoted = F.regexp_extract(c, r"^\s*'[^']+'\s*\.\s*(.+)$", 1)
    dotted = F.regexp_extract(c, r"\.([^.]*)$", 1)
    return blank_to_null(identifier(F.when(bracket != "", bracket).when(quoted != "", quoted).otherwise(dotted)))


def cardinality(c: Column, default: str) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin("one", "1"), "one").when(x.isin("many", "*"), "many").otherwise(F.coalesce(blank_to_null(x), F.lit(default)))


def cardinality_label(start: Column, end: Column) -> Column:
    word = lambda c: F.when(c == "many", "Many").otherwise("One")
    return F.concat(word(start), F.lit("-to-"), word(end))


def filter_direction(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin("singledirection", "single", "onedirection") | c.isNull(), "Single").when(x.isin("bothdirections", "both"), "Both").otherwise(c)


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s_\-\.]+"), lambda t: t != "")


def url_host(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(c, r"(?i)https?://([^/]+)", 1)))


def path_suffix(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(c, r"(\.[A-Za-z0-9]+)$", 1)))


def quoted_values(c: Column) -> Column:
    """All double-quoted values, then all single-quoted ones."""
    return F.concat(F.regexp_extract_all(c, F.lit('"([^"]*)"'), F.lit(1)), F.regexp_extract_all(c, F.lit("'([^']*)'"), F.lit(1)))


def source_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary")), 1, 12)


def dedup_key(*parts: Column) -> Column:
    return F.md5(F.lower(F.concat_ws("|", *parts)).cast("binary"))


def markdown_cell(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|")))


def valid_text(c: Column) -> Column:
    """Bytes as text, what is not UTF-8 left out."""
    return F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))


def capped(n: Column, per_unit: float, most: float) -> Column:
    return F.least(F.lit(most), n * F.lit(per_unit))


def mean(c: Column) -> Column:
    """The mean of numbers with two decimals, summed exactly: the order of the rows does not count. An aggregate."""
    return F.try_divide(F.sum(c.cast("decimal(18,2)")).cast("double"), F.count(c).cast("double"))


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def first_seen(items: Column) -> Column:
    """``items`` without repeats, in the order in which each is seen first; nulls and empty ones are left out."""
    return F.array_distinct(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""))
