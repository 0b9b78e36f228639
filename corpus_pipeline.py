"""Corpus preparation: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` applies
them to the documents; every stage's result is written as Parquet and read
again, so that each works on just what its predecessor kept.  All stages but the
last return the columns of the documents, extra ones included.  Texts are read
whole, however long; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import near_dedup, packing, pii, quality
from ledgerloom.session import load, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are scored like others; repeated rows go or stay
    together; if the labels tell nothing, all stay.
    """
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    A group is made of texts: of an id that occurs with several texts, only the
    rows go whose own text has a near-duplicate that stays.  Of rows that agree
    in id and text, one stays.  Texts without words all stay.
    """
    return near_dedup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; character counts follow the new texts.

    All rows and columns stay; a null text stays null.
    """
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every part of every document; null and empty texts have length 0."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: No SQL: the stages learn, hash and pack.  The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
