"""A corpus pipeline: quality, near-duplicates, personal data, source weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read back as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import bpe, minhash, mixing, pii, quality
from auditloom.llm.common import fresh_names, materialize, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels beside the tables.

    A null text is an empty one, which scores the share of good labels. Repeated rows share their score.
    """
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: of the smallest id, and of its texts one.

    Rows without id take part under a number made from their text, above all
    usual ids: of their group one stays, with an id if any has one. Repeated
    rows are one row; a null text is an empty one, and such rows are no group.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    found = minhash.near_duplicates(docs.select(number.alias("doc_id"), "text"))
    keys = fresh_names("number", "mark")
    kept = materialize(found.where("kept").groupBy(F.col("doc_id").alias(keys[0])).agg(F.min("mark").alias(keys[1])), "kept")
    rows = docs.withColumn(keys[0], number).withColumn(keys[1], F.xxhash64("text"))
    # one shuffle of the texts: rows meet their number and mark, and repeated ones each other
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes the name of its kind; n_chars follows. A null text stays null; repeated rows change alike."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; documents without words are taken or not by their id's hash alone."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document that is left, repeats included, and digests of ids and decoded text. A null text has no tokens."""
    return bpe.encode(docs).drop("decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source weights", mix_sources),
    ("tokens", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
