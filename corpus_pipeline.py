"""Corpus preparation in stages; each stage reads all that the one before kept.

Language ID drops documents without a known or with an ambiguous language, near-dedup
all but one document of each group, substring dedup the words that repeated 35-word
windows cover (and documents of which nothing is left), decontamination the documents
that hold a benchmark item. Packing gives one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, lang_id, simhash, substring_dedup, tokens
from tapeloom.llm.text import documents, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs, lang_id.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.unique_documents(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(docs).filter(F.col("text") != "")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.pack_powers(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints, learned models and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
