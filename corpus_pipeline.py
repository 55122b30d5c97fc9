"""A training corpus in five stages: known language, one of each near copy, no repeated passages, no benchmark, packed.

Each stage takes what the one before kept, reread from the table that it was written to. ``run`` applies them all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm import decontam, langid, packing, simhash, substrings
from factline.llm.common import save

#: The least share of the best language for a text to count as of a known language.
MIN_LANGUAGE_SCORE = 0.5
#: Shorter texts tell too little to be rejected by their score.
MIN_LANGUAGE_WORDS = 5


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; texts without a letter go, and longer ones of no clear language."""
    return langid.accepted(docs, langid.train(docs), MIN_LANGUAGE_SCORE, min_words=MIN_LANGUAGE_WORDS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that one of smaller id has nearly alike."""
    return _measured(substrings.cleaned(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without windows of benchmark texts."""
    return _measured(decontam.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs


#: Fingerprints, compact windows and tokenizer steps have no SQL; `tests/llm/test_pipeline.py` holds the stages against brute force.
ORACLE_SQL = None
