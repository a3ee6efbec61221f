"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import stages
from tessella.session import materialize

STAGES = [
    ("language_id", stages.language_id),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("personal_data", stages.personal_data),
    ("sentencepiece", stages.sentencepiece),
]

#: Learned models and library tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
