"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, encode.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``; the last returns token ids.
Null text counts as empty. Rows repeated under one id, or under a null one, are rows of their own and judged one by one; where
one of several rows stays, that is the smallest id (in exact dedup a null id comes before all others, in the join after them). Empty tables
pass through, columns of any name are kept, and texts are taken whole however long they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docengine.llm import bpe, decontamination, exact_dedup, ngram_join, toxicity
from docengine.llm.common import staged, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not found toxic."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every text, that of the smallest id."""
    return exact_dedup.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts linked by their shingles, that of the smallest id."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark; items with a null id or no text match nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers), decoded."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

# Trained and similarity stages have no SQL form; the tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
