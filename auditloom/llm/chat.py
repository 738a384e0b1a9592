"""Chat formatting by relational means: DataFrame expressions only, no Python on the executors.

A conversation's turns are collected as structs, sorted by (turn, role, text) and
merged: neighbours of one role share a block. The template is::

    <|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n

``<|im_sep|>`` stands between merged turns, so the turns can be read back.
Inside texts one backslash is put after each ``<`` that is followed by
backslashes (or none) and ``|``: no control string is left in a text, and taking
one backslash away again restores it. Roles are URL-encoded.

Nulls: a null text or role is empty; null turns come first; a null ``conv_id``
is one conversation. Repeated rows are turns of their own, ties are ordered by
role and text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_mask: runs (loss, chars) that cover ``formatted``; a run under loss is one turn of role ``trained``."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    before = lambda i: F.try_element_at("turns", i)  # noqa: E731  1-based: the turn before the one at 0-based i
    after = lambda i: F.try_element_at("turns", i + 2)

    def piece(t: Column, i: Column) -> Column:
        joins = (i > 0) & before(F.greatest(i, F.lit(1))).getField("role").eqNullSafe(t["role"])
        goes_on = after(i).getField("role").eqNullSafe(t["role"])
        return F.struct(
            F.when(joins, F.lit(SEP)).otherwise(F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(goes_on, F.lit("")).otherwise(F.lit(END + "\n")).alias("tail"),
            (t["role"] == trained).alias("loss"),
        )

    def run(loss: Column, text: Column) -> Column:
        return F.struct(loss.alias("loss"), F.char_length(text).cast("long").alias("chars"))

    pieces = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten(F.transform("pieces", lambda p: F.array(run(F.lit(False), p["head"]), run(p["loss"], p["body"]), run(F.lit(False), p["tail"])))).alias("loss_mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns (role, text) and loss_texts, read back from ``formatted`` and ``loss_mask`` alone.

    Bodies are cut out of the formatted text at its control strings; the mask's
    every third run from the second on is a body, and must have its length.
    """
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        rest = F.regexp_replace(block, r"\A[^\n]*\n", "")
        body = F.regexp_replace(rest, r"<\|im_end\|>\n\z", "")
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(F.url_decode(role).alias("role"), x.alias("body")))

    cut = formatted.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.flatten(F.transform(blocks, turns_of)).alias("cut"),
        F.filter("loss_mask", lambda x, i: i % 3 == 1).alias("runs"),
    )
    marked = F.zip_with("cut", "runs", lambda t, r: F.struct(t["role"].alias("role"), unescape(t["body"]).alias("text"), r["loss"].alias("loss"), (F.char_length(t["body"]) == r["chars"]).alias("fits")))
    read = cut.select("conv_id", "formatted_chars", marked.alias("marked"))
    fits = F.forall("marked", lambda x: F.coalesce(x["fits"], F.lit(False)))
    return read.select(
        "conv_id",
        "formatted_chars",
        F.transform("marked", lambda x: F.struct(x["role"], x["text"])).alias("turns"),
        F.when(fits, F.transform(F.filter("marked", lambda x: x["loss"]), lambda x: x["text"])).otherwise(F.raise_error(F.lit("the loss mask does not fit the text"))).alias("loss_texts"),
    )
