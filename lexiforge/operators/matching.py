"""Matching algorithms: each turns (column, term, options) into a Boolean Column.

The pattern algorithms compare lower-case forms with literal-escaped patterns. With native=True, levenshtein, soundex
and trigram use Spark's own functions instead of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.config import DEFAULT, Settings
from lexiforge.errors import InvalidConfig, UnknownAlgorithm
from lexiforge.functions import expressions as X
from lexiforge.functions import patterns as P
from lexiforge.functions.phonetic import metaphone, metaphone_udf, weighted_distance_udf

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
Algorithm = Callable[[str, str, dict[str, Any]], Column]


def checked(column: str) -> str:
    """The column's name; ValueError unless it is letters, digits, _ and dots."""
    if not isinstance(column, str) or not NAME.fullmatch(column):
        raise ValueError(f"{column!r} can't be a column's name")
    return column


def _patterns(make: Callable[..., list[str]]) -> Algorithm:
    def match(column: str, term: str, o: dict[str, Any]) -> Column:
        found = make(term, o)
        if (most := o.get("max_patterns")) is not None:
            found = found[: max(10, most)]
        return X.like_any(X.text(column), P.without_covered(found))

    return match


def simple(column: str, term: str, o: dict[str, Any]) -> Column:
    return F.lower(X.text(column)).contains(term.lower())


_lev_patterns = _patterns(lambda t, o: P.levenshtein_patterns(t, o.get("max_distance", DEFAULT.max_distance), False))
_tri_patterns = _patterns(lambda t, o: P.trigram_patterns(t))
_sound_patterns = _patterns(lambda t, o: P.soundex_patterns(t))


def levenshtein(column: str, term: str, o: dict[str, Any]) -> Column:
    """native: the whole column within max_distance ("similar": trigram similarity above 1 - distance / length, at least 0.3)."""
    native, d = o.get("native", False), o.get("max_distance", DEFAULT.max_distance)
    if native == "similar":
        return X.trigram_similarity(X.text(column), term) > max(0.3, 1 - d / max(len(term), 1))
    return X.within(X.text(column), term, d) if native else _lev_patterns(column, term, o)


def soundex(column: str, term: str, o: dict[str, Any]) -> Column:
    if not o.get("native", False):
        return _sound_patterns(column, term, o)
    code, c = F.soundex(F.lit(term)), X.text(column)
    return (F.soundex(X.first_word(c)) == code) | (F.soundex(X.last_word(c)) == code)


def trigram(column: str, term: str, o: dict[str, Any]) -> Column:
    if not o.get("native", False):
        return _tri_patterns(column, term, o)
    return X.trigram_similarity(X.text(column), term) > o.get("min_similarity", DEFAULT.trigram_min_similarity) / 100


def by_metaphone(column: str, term: str, o: dict[str, Any]) -> Column:
    """Equality with the shadow column; see add_shadow_column. The DataFrame's columns are checked where they are known."""
    shadow = f"{column}_metaphone"
    if (there := o.get("available")) is not None and shadow not in there:
        raise InvalidConfig(f"metaphone needs the column {shadow}: add_shadow_column(df, {column!r}) makes it", column=shadow)
    return F.col(shadow) == F.lit(metaphone(term))


ALGORITHMS: dict[str, Algorithm] = {
    "fuzzy": _patterns(lambda t, o: P.fuzzy_patterns(t, False)),
    "levenshtein": levenshtein,
    "like": simple,
    "metaphone": by_metaphone,
    "similar_text": lambda c, t, o: simple(c, t.strip(), o),
    "simple": simple,
    "soundex": soundex,
    "trigram": trigram,
}


def register_algorithm(name: str, match: Algorithm) -> None:
    """Makes match(column, term, options) available under a name."""
    ALGORITHMS[name] = match


def fuzzy_match(column: str, term: str, algorithm: str | None = None, settings: Settings = DEFAULT, **options: Any) -> Column:
    """Whether the column matches the term by the algorithm.

    accent_insensitive together with native compares accent-folded forms by containment instead.
    """
    checked(column)
    name = algorithm or settings.algorithm
    if name not in ALGORITHMS:
        if not settings.unknown_algorithm_is_levenshtein:
            raise UnknownAlgorithm(name, list(ALGORITHMS))
        name = "levenshtein"
    options = {"max_distance": settings.max_distance, "min_similarity": settings.trigram_min_similarity, "native": settings.use_native} | options
    if options["native"] and options.get("accent_insensitive") and name != "metaphone":
        return X.fold(X.text(column)).contains(_folded(term))
    return ALGORITHMS[name](column, term, options)


def _folded(term: str) -> str:
    from lexiforge.functions.terms import remove_accents

    return remove_accents(term).lower()


def fuzzy_match_any(columns: Sequence[str], term: str, algorithm: str | None = None, settings: Settings = DEFAULT, **options: Any) -> Column:
    """Whether one of the columns matches."""
    if not columns:
        raise ValueError("no columns")
    return reduce(or_, [fuzzy_match(c, term, algorithm, settings, **options) for c in columns])


# -- for df.transform(...)


def where_fuzzy(column: str, term: str, algorithm: str | None = None, **options: Any):
    return lambda df: df.where(fuzzy_match(column, term, algorithm, available=df.columns, **options))


def where_fuzzy_multiple(columns: Sequence[str], term: str, algorithm: str | None = None, **options: Any):
    return lambda df: df.where(fuzzy_match_any(columns, term, algorithm, available=df.columns, **options))


def where_any(columns: str | Sequence[str], term: str, **options: Any):
    """With the default algorithm, over one column or several."""
    return where_fuzzy_multiple([columns] if isinstance(columns, str) else columns, term, None, **options)


def where_levenshtein(columns: Sequence[str], term: str, max_distance: int = 3):
    return where_fuzzy_multiple(columns, term, "levenshtein", max_distance=max_distance)


def where_soundex(columns: Sequence[str], term: str):
    return where_fuzzy_multiple(columns, term, "soundex")


def where_similar(columns: Sequence[str], term: str):
    return where_fuzzy_multiple(columns, term, "similar_text")


def or_where_fuzzy(before: Column, column: str, term: str, algorithm: str | None = None, **options: Any) -> Column:
    """before OR the match: to be given to where()."""
    return before | fuzzy_match(column, term, algorithm, **options)


def order_by_fuzzy(column: str, term: str, direction: str = "asc"):
    """Orders by the place of term in the column; rows without it have place 0."""
    checked(column)
    if direction.lower() not in ("asc", "desc"):
        raise ValueError(f"{direction!r} is no direction")
    at = X.position(X.text(column), term)
    return lambda df: df.orderBy(at.desc() if direction.lower() == "desc" else at.asc())


def filter_fuzzy(column: str, term: str, max_distance: int = 3):
    """Rows whose column is within max_distance edits of the term, ignoring case."""
    return lambda df: df.where(X.within(F.lower(X.text(checked(column))), term.lower(), max_distance))


def sort_by_fuzzy(column: str, term: str, direction: str = "asc"):
    """Orders by edit distance from the term, ignoring case."""
    d = X.levenshtein(X.text(checked(column)), term)
    return lambda df: df.orderBy(d.desc() if direction.lower() == "desc" else d.asc())


def levenshtein_distance(a: Column, b: Column | str, *, insert: int = 1, replace: int = 1, delete: int = 1, in_bytes: bool = False) -> Column:
    """Edit distance ignoring case; other costs than 1 need a UDF, over bytes."""
    if (insert, replace, delete) == (1, 1, 1):
        return X.levenshtein(a, b, in_bytes=in_bytes)
    return weighted_distance_udf(insert, replace, delete)(a, F.lit(b) if isinstance(b, str) else b)


def add_shadow_column(df: DataFrame, column: str) -> DataFrame:
    """df with {column}_metaphone, the sound of the column; null where it is null."""
    return df.withColumn(f"{checked(column)}_metaphone", metaphone_udf(X.text(column)))
