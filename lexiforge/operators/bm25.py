"""Ranking by BM25 over an inverted index.

    idf = ln((N - df + 0.5) / (df + 0.5) + 1);  tf = f (k1 + 1) / (f + k1 (1 - b + b length / average))

The query's terms are literals, so the postings scan is pruned by them; their document counts come from the dictionary, and
lengths stand in the postings, so that no table of documents is read. One shuffle adds up the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.config import DEFAULT, Settings
from lexiforge.sources.index import Index


def contribution(f: Column, df: Column, n: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    d = lambda c: c.cast("double")
    idf = F.log((d(n) - d(df) + 0.5) / (d(df) + 0.5) + 1.0)
    return idf * (d(f) * (k1 + 1.0) / (d(f) + k1 * (1.0 - b + b * d(length) / average)))


def _average(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(1.0)


def matches(index: Index, terms: Sequence[str], settings: Settings = DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """The postings of the terms with length, df and totals: model_id, term, frequency, doc_length, doc_count, and the meta row."""
    wanted = F.col("term").isin(*terms) if terms else F.lit(False)
    postings = index.postings.where(wanted)
    if settings.max_postings is not None:
        postings = postings.orderBy(F.desc("frequency"), "model_id", "term").limit(settings.max_postings)
    counts = (dictionary if dictionary is not None else index.terms).where(wanted)
    return postings.join(F.broadcast(counts), "term").crossJoin(F.broadcast(index.meta))


def scores(index: Index, terms: Sequence[str], settings: Settings = DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """model_id and score, to 6 decimals, of every document with a term.

    dictionary: other document counts than the index's own, such as counts over all corpora.
    """
    m = matches(index, terms, settings, dictionary)
    part = contribution(F.col("frequency"), F.col("doc_count"), F.col("total_docs"), F.col("doc_length"), _average(F.col("avg_doc_length")), settings.k1, settings.b)
    return m.groupBy("model_id").agg(F.round(F.sum(part), 6).alias("score"))


def search(index: Index, terms: Sequence[str], limit: int, settings: Settings = DEFAULT, dictionary: DataFrame | None = None) -> DataFrame:
    """The best documents: model_id, score."""
    return scores(index, terms, settings, dictionary).orderBy(F.desc("score"), "model_id").limit(limit)


def count(index: Index, terms: Sequence[str]) -> int:
    """Documents with one of the terms."""
    return index.postings.where(F.col("term").isin(*terms)).select("model_id").distinct().count() if terms else 0


def search_many(index: Index, queries: DataFrame, limit: int, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, rank, model_id, score: many queries (query_id, term; one row a term) in one plan.

    All share one scan of the postings and one shuffle; the number of queries isn't bounded by the driver. Up to
    settings.broadcast_rows terms of queries are broadcast to the postings, more are joined by shuffling.
    """
    q = queries.select("query_id", "term").distinct()
    small = q.limit(settings.broadcast_rows + 1).count() <= settings.broadcast_rows
    words = q.select("term").distinct()
    counts = index.terms.join(F.broadcast(words) if small else words, "term", "left_semi")
    q = q.join(F.broadcast(counts) if small else counts, "term")
    m = index.postings.join(F.broadcast(q) if small else q, "term").crossJoin(F.broadcast(index.meta))
    part = contribution(F.col("frequency"), F.col("doc_count"), F.col("total_docs"), F.col("doc_length"), _average(F.col("avg_doc_length")), settings.k1, settings.b)
    s = m.groupBy("query_id", "model_id").agg(F.round(F.sum(part), 6).alias("score"))
    return s.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, model_id)")).where(F.col("rank") <= limit).select("query_id", "rank", "model_id", "score")
