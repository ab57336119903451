"""Relevance: the recall order that picks candidates, and the score that ranks them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import expressions as X
from lexiforge.functions.phonetic import similar_text_udf


def recall_score(weights: Mapping[str, float], term: str, prefix_boost: float = 1.0) -> Column:
    """Sum over columns of 100 w if equal, 50 w boost if a prefix, 10 w if contained; the tiers add up."""
    low = term.lower()
    parts = []
    for c, w in weights.items():
        v = X.text(c)
        parts += [
            F.when(v == F.lit(term), float(100 * w)).otherwise(0.0),
            F.when(F.lower(v).startswith(low), float(50 * w * prefix_boost)).otherwise(0.0),
            F.when(F.lower(v).contains(low), float(10 * w)).otherwise(0.0),
        ]
    return reduce(add, parts) if parts else F.lit(0.0)


def column_score(column: str, weight: float, term: str, prefix_boost: float = 1.0, typo_tolerance: int = 2, similar: bool = True) -> Column:
    """100, 80 or 60 times the weight for equal, prefix or contained; else by similarity or edit distance, up to 50.

    The similarity UDF gets null, and does nothing, where a cheaper tier decides; similar=False leaves it out.
    """
    t, w = term.lower(), float(weight)
    v = F.lower(F.coalesce(X.text(column), F.lit("")))
    cheap = (v == t) | v.startswith(t) | v.contains(t)
    d = F.levenshtein(v, F.lit(t), typo_tolerance)
    by_edits = F.when(d >= 0, F.greatest(F.lit(0), 20 - 4 * d) * w).otherwise(0.0)
    rest = by_edits
    if similar:
        rest = F.greatest(similar_text_udf(F.when(~cheap, F.lit(t)), F.when(~cheap, v)) / 100 * 50 * w, by_edits)
    return F.when(v == t, 100 * w).when(v.startswith(t), 80 * w * prefix_boost).when(v.contains(t), 60 * w).otherwise(rest)


def recency(column: Column, multiplier: float, days: int, as_of: Column) -> Column:
    """A factor from `multiplier` for today down to 1 at `days` whole days of distance; 1 for null and unreadable dates."""
    at = F.try_to_timestamp(column.cast("string"))
    gap = F.floor(F.abs(F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)
    return F.coalesce(F.when(gap <= days, 1 + (multiplier - 1) * (1 - gap / days)), F.lit(1.0))


def normalised(df: DataFrame, raw: Column) -> DataFrame:
    """df with _raw_score, raw to 2 decimals, and _score, its share of the greatest, to 6; null and 0 where that is 0."""
    df = df.withColumn("_raw_score", F.round(raw, 2))
    top = F.max("_raw_score").over(Window.partitionBy(F.lit(0)))
    df = df.withColumn("_max", top)
    return df.withColumn("_score", F.when(F.col("_max") > 0, F.round(F.col("_raw_score") / F.col("_max"), 6)).otherwise(0.0)).withColumn("_raw_score", F.when(F.col("_max") > 0, F.col("_raw_score"))).drop("_max")
