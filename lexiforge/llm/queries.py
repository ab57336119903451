"""Queries over the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import bpe, fingerprints, language_id, near_dedup, packing, pii, suffix_dedup, token_rollup, topk, url_filter
from lexiforge.llm.base import table

#: The vocabulary that the queries encode with.
RANKS = bpe.RANKS


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of operator 2 between classes."""
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_report(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), RANKS)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.corpus_rollup(table(spark, sf_dir, "documents"))


def bpe_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on the tokens of operator 5."""
    return token_rollup.corpus_rollup(table(spark, sf_dir, "documents"), {"bpe-50k": RANKS})


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=topk.EVERY)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(url_filter.page_captures(spark, sf_dir), url_filter.page_entries(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_document_fingerprints, op3_near_dedup, op4_packing, op5_bpe, op6_token_rollup, op7_pii, op8_suffix_dedup, op9_topk, op10_url_filter, fingerprint_pairs, bpe_token_rollup)}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": url_filter.ORACLE, "op9_topk": topk.ORACLE, "op6_token_rollup": token_rollup.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE}
