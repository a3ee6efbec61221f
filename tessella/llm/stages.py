"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame with the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, pii, piece_codec, simhash
from tessella.llm.common import read

#: A document goes if no language is at least this likely, or if its text has no letter.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    model = langid.fit(langid.learning_rows(docs))
    out = langid.identify(docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"}), model)
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return out.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"})


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate group."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``benchmark``."""
    return decontam.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind."""
    return pii.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    return piece_codec.digest(docs)
