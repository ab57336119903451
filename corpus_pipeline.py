"""The corpus pipeline over the documents table: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return
the columns of documents. Stages run in a session of small batches, since executors may be small; see base.bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import bpe, language_id, near_dedup, packing, pii, suffix_dedup
from lexiforge.llm.base import bounded, discard, saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no determined language go, and those whose text clearly refutes their label."""
    return language_id.keep_identified(bounded(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.near_dedup(bounded(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat an earlier one are cut out of the texts; n_chars follows."""
    return suffix_dedup.remove_repeats(bounded(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts are replaced by their labels; n_chars follows."""
    return pii.redact(bounded(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training windows of the documents, in order."""
    return packing.pack(bounded(docs), bpe.RANKS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; between stages the documents are written and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
            discard(*before)
            before = [docs]
    return docs


#: SQL expresses neither the classifiers nor the sketches nor the dynamic programme; the tests use brute force.
ORACLE_SQL = None
