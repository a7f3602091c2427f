"""Corpus preparation: language, exact copies, near copies, benchmark leaks, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
documents; the last returns packed pieces. Each stage is judged by its own input: the language model is learnt from
the documents that reach it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, exact_dedup, language, near_dedup, packing
from emberline.storage import materialize


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs, language.learn(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", in_a_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("packing", packed),
]

# SQL cannot express the language, near-duplicate, tiling and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; every result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
