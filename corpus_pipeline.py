"""Corpus pipeline: reject poor documents, drop near copies, redact personal
data, mix the sources, pack into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. A document that
the mix takes more than once is as many rows, and each is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from featflow.llm import mixing, near_dup, packing, pii, quality_model
from featflow.llm.store import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject (operator 9)."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest id (operator 1,
    at similarity 0.8; 43 bands of 5 miss a pair there with probability 4e-8)."""
    return near_dup.drop_near_duplicates(docs, num=80, bands=43, rows=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by marks (operator 5)."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks (operator 3)."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in packed sequences (operator 7)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("source_mix", source_mix), ("sequences", sequences)]
ORACLE_SQL = None       # the trained stages and the packing have no SQL; tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = written(docs, name)
    return docs
