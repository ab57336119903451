"""The search builder: an immutable description of a search over a DataFrame, compiled to one lazy plan.

get() = match -> keep the max_candidates best by recall order -> score these -> rank -> slice -> decorate. Every
order ends in the key column, so results are the same in every run.
"""

from __future__ import annotations

import hashlib
import html
import re
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from lexiforge.config import DEFAULT, LIKELY_COLUMNS, SEARCH_STOP_WORDS, SYSTEM_COLUMNS, Settings
from lexiforge.errors import EmptySearchTerm, InvalidConfig, NoSearchableColumns, NotSupported, UnknownAlgorithm
from lexiforge.functions import expressions as X
from lexiforge.functions import patterns as P
from lexiforge.functions import terms as T
from lexiforge.operators import bm25
from lexiforge.operators.matching import ALGORITHMS, checked, fuzzy_match
from lexiforge.operators.scoring import column_score, normalised, recall_score, recency
from lexiforge.plans import boolean
from lexiforge.sources.index import Analyzer, IndexStore

_TAG = re.compile(r"[A-Za-z][A-Za-z0-9-]*")
_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "like": lambda c, v: F.lower(c.cast("string")).like(str(v).lower()),
    "not like": lambda c, v: ~F.lower(c.cast("string")).like(str(v).lower()),
}
_UNSET = object()


@dataclass(frozen=True)
class SearchRan:
    """What listeners get for each search that ran."""

    term: str
    columns: tuple[str, ...]
    algorithm: str
    candidates: int
    milliseconds: float


_listeners: list[Callable[[SearchRan], None]] = []


def on_search(listener: Callable[[SearchRan], None]) -> Callable[[], None]:
    """Calls listener after each search that runs; returns what takes it off again."""
    _listeners.append(listener)
    return lambda: _listeners.remove(listener)


@dataclass(frozen=True)
class Page:
    items: DataFrame
    page: int
    per_page: int
    total: int | None = None
    has_more: bool | None = None

    @property
    def last_page(self) -> int | None:
        return None if self.total is None else max(1, -(-self.total // self.per_page))


def likely_columns(df: DataFrame) -> dict[str, int]:
    """Columns to search where none are named: of well-known names, else the first strings, else the first at all."""
    found = {c: w for c, w in LIKELY_COLUMNS.items() if c in df.columns}
    if not found:
        found = dict.fromkeys([c for c, t in df.dtypes if t == "string" and c not in SYSTEM_COLUMNS][:5], 1)
    return found or dict.fromkeys([c for c in df.columns if c not in SYSTEM_COLUMNS][:1], 1)


_cache: dict[str, tuple[float, DataFrame]] = {}


def clear_cache() -> None:
    while _cache:
        _cache.popitem()[1][1].unpersist()


@dataclass(frozen=True)
class Search:
    df: DataFrame
    key: str = ""
    settings: Settings = DEFAULT
    term: str = ""
    weights: Mapping[str, float] = field(default_factory=dict)
    algorithm: str | None = None
    typos: int = 2
    options_: Mapping[str, Any] = field(default_factory=dict)
    tokens: bool = False
    all_tokens: bool = False
    boost: float = 1.0
    partial: bool = False
    shortest_match: int = 2
    scorer: Callable[[Column], Column] | None = None
    stop_words: tuple[str, ...] = ()
    synonyms: Mapping[str, Sequence[str]] = field(default_factory=dict)
    groups: tuple[tuple[str, ...], ...] = ()
    locale_: str | None = None
    accents: bool | None = None
    nfc: bool = False
    tags: tuple[str, str] | None = None
    debug: bool = False
    filters: tuple[tuple[str, str, Any], ...] = ()
    facets: tuple[str, ...] = ()
    relevance: bool = True
    size: int = 15
    start: int = 0
    order: tuple[tuple[str, str], ...] = ()
    recent: tuple[float, str, int, Any] | None = None
    query: str | None = None
    store: IndexStore | None = None
    corpus: str | None = None
    indexed: bool = False
    analyzer: Analyzer = Analyzer()
    cached: tuple[float, str | None] | None = None
    fallbacks: tuple[str, ...] = ()
    stable: bool = False

    def __post_init__(self):
        if not self.key:
            object.__setattr__(self, "key", "id" if "id" in self.df.columns else self.df.columns[0])
        if self.accents is None:
            object.__setattr__(self, "accents", self.settings.accent_insensitive)

    def _(self, **changes: Any) -> Search:
        return replace(self, **changes)

    # -- what to search for

    def search(self, term: str) -> Search:
        return self._(term=term)

    def search_in(self, columns: Mapping[str, float] | Sequence[str]) -> Search:
        """Columns and whole-number weights; a list has weights of 1. A column named again gets the new weight."""
        new = dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(columns, 1)
        return self._(weights={**self.weights, **{checked(c): int(w) for c, w in new.items()}})

    def extended(self, query: str | None = None) -> Search:
        """Reads the term, or the query given, as a boolean query."""
        term = self.term if query is None else query
        return self._(term=term, query=term)

    search_boolean = extended

    def using(self, algorithm: str) -> Search:
        if algorithm not in ALGORITHMS:
            raise UnknownAlgorithm(algorithm, list(ALGORITHMS))
        return self._(algorithm="simple" if algorithm == "like" else algorithm)

    def typo_tolerance(self, n: int) -> Search:
        n = max(0, min(5, n))
        return self._(typos=n, options_={**self.options_, "max_distance": n})

    def tokenize(self) -> Search:
        return self._(tokens=True)

    def match_all(self) -> Search:
        return self._(all_tokens=True)

    def match_any(self) -> Search:
        return self._(all_tokens=False)

    def options(self, **options: Any) -> Search:
        return self._(options_={**self.options_, **options})

    def max_patterns(self, n: int) -> Search:
        return self.options(max_patterns=max(10, n))

    # -- the term's treatment

    def ignore_stop_words(self, words: Iterable[str] | str | None = None) -> Search:
        """Words, or the list of a locale (none for an unknown one); without an argument the English list."""
        if words is None or isinstance(words, str):
            words = SEARCH_STOP_WORDS.get(words or "en", ())
        return self._(stop_words=tuple(w.lower() for w in words))

    def with_synonyms(self, synonyms: Mapping[str, Sequence[str]]) -> Search:
        return self._(synonyms={**self.synonyms, **{k.lower(): tuple(v) for k, v in synonyms.items()}})

    def synonym_group(self, words: Sequence[str]) -> Search:
        return self._(groups=(*self.groups, tuple(words)))

    def accent_insensitive(self, on: bool = True) -> Search:
        return self._(accents=on)

    def unicode_normalize(self) -> Search:
        return self._(nfc=True)

    def locale(self, name: str) -> Search:
        """Kept for callers' use; no search depends on it."""
        return self._(locale_=name)

    def debounce(self, milliseconds: int) -> Search:
        """A matter of user interfaces; does nothing here."""
        return self

    def partial_match(self) -> Search:
        """Kept for callers' use: all algorithms match parts."""
        return self._(partial=True)

    def min_match_length(self, n: int) -> Search:
        return self._(shortest_match=max(1, n))

    # -- scores and order

    def prefix_boost(self, by: float) -> Search:
        return self._(boost=max(1.0, by))

    def custom_score(self, scorer: Callable[[Column], Column]) -> Search:
        """scorer gets the score as a Column, and gives the one to use; it may read the row's columns."""
        return self._(scorer=scorer)

    def boost_recent(self, multiplier: float = 1.5, column: str = "created_at", days: int = 30, as_of: Any = None) -> Search:
        """as_of: the time that counts as now, as text or datetime; the current time by default."""
        return self._(recent=(max(1.0, multiplier), checked(column), max(1, days), as_of))

    def with_relevance(self, on: bool = True) -> Search:
        return self._(relevance=on)

    def order_by(self, column: str, direction: str = "asc") -> Search:
        if direction.lower() not in ("asc", "desc"):
            raise ValueError(f"{direction!r} is no direction")
        return self._(order=(*self.order, (checked(column), direction.lower())))

    def stable_ranking(self) -> Search:
        """Every order ends in the key anyway."""
        return self._(stable=True)

    # -- filters, facets, slices

    def filter(self, column: str, operator: Any, value: Any = _UNSET) -> Search:
        """Keeps rows by a comparison; two arguments mean equality, and so does a value of None with the operator as the value."""
        if value is _UNSET or value is None:
            operator, value = "=", operator
        if str(operator).lower() not in _COMPARE:
            raise ValueError(f"{operator!r} is no comparison")
        return self._(filters=(*self.filters, (checked(column), str(operator).lower(), value)))

    def filter_in(self, column: str, values: Sequence[Any]) -> Search:
        return self._(filters=(*self.filters, (checked(column), "in", tuple(values))))

    def facet(self, column: str) -> Search:
        return self._(facets=(*self.facets, checked(column)))

    def take(self, n: int) -> Search:
        return self._(size=n)

    limit = take

    def skip(self, n: int) -> Search:
        return self._(start=n)

    offset = skip

    def page(self, n: int, per_page: int = 15) -> Search:
        return self._(size=per_page, start=(n - 1) * per_page)

    # -- decoration

    def highlight(self, tag: str = "em", close: str | None = None) -> Search:
        """A tag's name, or an opening and a closing text."""
        if close is not None:
            return self._(tags=(tag, close))
        if not _TAG.fullmatch(tag):
            raise ValueError(f"{tag!r} can't be a tag")
        return self._(tags=(f"<{tag}>", f"</{tag}>"))

    def debug_score(self) -> Search:
        return self._(debug=True, relevance=True)

    # -- the index, presets, cache, fallbacks

    def use_inverted_index(self, corpus: str | bool | None = True, store: IndexStore | None = None, analyzer: Analyzer | None = None) -> Search:
        """Ranks by BM25 over the corpus's index; False goes back to matching. Filters, order and weights don't apply."""
        if corpus is False:
            return self._(indexed=False, corpus=None)
        return self._(indexed=True, corpus=corpus if isinstance(corpus, str) else self.corpus, store=store or self.store, analyzer=analyzer or self.analyzer)

    use_index = use_inverted_index

    def preset(self, name: str) -> Search:
        p = self.settings.presets.get(name)
        if p is None:
            raise InvalidConfig(f"no preset {name!r}; there are {', '.join(sorted(self.settings.presets))}", preset=name)
        s = self
        if p.get("columns"):
            s = s.search_in(p["columns"])
        if p.get("algorithm"):
            s = s.using(p["algorithm"])
        if "typo_tolerance" in p:
            s = s.typo_tolerance(p["typo_tolerance"])
        if p.get("accent_insensitive"):
            s = s.accent_insensitive()
        if p.get("partial_match"):
            s = s.partial_match()
        if p.get("stop_words"):
            from lexiforge.config import INDEX_STOP_WORDS

            s = s.ignore_stop_words(INDEX_STOP_WORDS.get(p.get("locale", self.settings.locale), ()))
        return s

    def cache(self, minutes: float | None = 60, key: str | None = None) -> Search:
        """Keeps the result persisted for so long; None keeps nothing."""
        return self._(cached=None if minutes is None else (minutes, key))

    def fallback(self, algorithm: str) -> Search:
        """The algorithm to try if the ones before find nothing."""
        if algorithm not in ALGORITHMS:
            raise UnknownAlgorithm(algorithm, list(ALGORITHMS))
        return self._(fallbacks=(*self.fallbacks, algorithm))

    # -- compilation

    @property
    def columns(self) -> list[str]:
        return list(self.weights)

    @property
    def _algorithm(self) -> str:
        return self.algorithm or self.settings.algorithm

    def _empty(self) -> bool:
        return self.term in ("", "0")

    def _guarded(self) -> Search | None:
        """The search with its term cut to the longest allowed; None if the term is too short to find anything."""
        if self.query is not None:
            return self
        if self._empty():
            if not self.settings.allow_empty_search:
                raise EmptySearchTerm
            return self
        if len(self.term) < self.settings.min_search_length:
            return None
        return self._(term=self.term[: self.settings.max_term_length])

    def processed_term(self) -> str:
        return T.prepare(self.term, nfc=self.nfc, accents=bool(self.accents), stop=self.stop_words)

    def predicate(self) -> Column | None:
        """The match as a Column; None where every row matches."""
        term = self.processed_term()
        if not term or term == "0" or not self.weights:
            return None
        words = term.split() if self.tokens else [term]
        each = [T.with_synonyms(w, self.synonyms, self.groups) for w in words]
        options = {**self.options_, "accent_insensitive": self.accents, "available": self.df.columns}
        options.setdefault("max_distance", self.settings.max_distance)
        hit = lambda t: reduce(or_, [fuzzy_match(c, t, self._algorithm, self.settings, **options) for c in self.weights])
        if self.tokens and self.all_tokens:
            return reduce(and_, [reduce(or_, map(hit, ts)) for ts in each])
        return reduce(or_, map(hit, dict.fromkeys(t for ts in each for t in ts)))

    def _filtered(self, df: DataFrame) -> DataFrame:
        for c, op, v in self.filters:
            df = df.where(F.col(c).isin(*v) if op == "in" else _COMPARE[op](F.col(c), v))
        return df

    def matched(self) -> DataFrame:
        """All matching rows, unranked, with filters applied."""
        if self.query is not None:
            return self._filtered(self.df.where(boolean.compiled(self.query, self._extended_columns(), self.settings)))
        p = self.predicate()
        return self._filtered(self.df if p is None else self.df.where(p))

    def _extended_columns(self) -> list[str]:
        if not self.weights:
            raise NoSearchableColumns
        return self.columns

    def _recall(self) -> list[Column]:
        """The order that picks candidates, and breaks ties of the score."""
        key = F.col(self.key).asc()
        if self.query is not None:
            return [key]
        if self.order:
            return [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in self.order] + [key]
        if self.relevance and not self._empty() and self.weights:
            return [recall_score(self.weights, self.term, self.boost).desc(), key]
        return [key]

    def candidates(self) -> DataFrame:
        """The best matches by recall order, in one partition, as a top-k.

        coalesce(1) moves nothing, since a top-k has one partition; without it the optimiser moves the scores below the
        limit, which turns the top-k into a sort of all matches and runs the similarity UDF on more than the candidates.
        """
        return self.matched().orderBy(*self._recall()).limit(self.settings.max_candidates).coalesce(1)

    def _all_contain(self) -> bool:
        """Whether each candidate is sure to contain the term, so that no similarity has to be computed."""
        one = len(self.weights) == 1 and self.query is None and not self.synonyms and not self.groups and not self.tokens
        plain = self._algorithm in ("simple", "similar_text") and not self.options_.get("native", self.settings.use_native)
        return one and plain and self.processed_term().lower() == self.term.lower()

    def _scored(self, df: DataFrame) -> DataFrame:
        similar = not self._all_contain()
        parts = {c: column_score(c, w, self.term, self.boost, self.typos, similar) for c, w in self.weights.items()}
        names = {c: f"_score_{i}" for i, c in enumerate(parts)}
        for c, s in parts.items():
            df = df.withColumn(names[c], s)
        raw = reduce(lambda a, b: a + b, [F.col(n) for n in names.values()]) if names else F.lit(0.0)
        if self.scorer is not None:
            raw = self.scorer(raw)
        if self.recent:
            m, c, days, as_of = self.recent
            now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
            raw = raw * recency(F.col(c), m, days, now)
        df = normalised(df, raw.cast("double"))
        if self.debug:
            scores = F.create_map(*[x for c in parts for x in (F.lit(c), F.col(names[c]))]) if parts else F.create_map().cast("map<string,double>")
            df = df.withColumn("_column_scores", scores)
        return df.drop(*names.values())

    def _decorated(self, df: DataFrame) -> DataFrame:
        if self.tags and not self._empty() and self.weights:
            found = {c: X.match_offsets(X.text(c), self.term) for c in self.weights}
            one = [F.when(F.size(o) > 0, F.struct(F.lit(c).alias("column"), X.text(c).alias("value"), o.alias("indices"))) for c, o in found.items()]
            shown = [x for c, o in found.items() for x in (F.lit(c), F.when(F.size(o) > 0, X.wrapped(X.text(c), o, *self.tags)).otherwise(X.text(c)))]
            df = df.withColumn("_matches", F.array_compact(F.array(*one))).withColumn("_highlighted", F.map_filter(F.create_map(*shown), lambda _, v: v.isNotNull() & (v != "")))
        if self.debug:
            has = set(df.columns)
            df = df.withColumn("_debug", F.struct(
                F.lit(self._algorithm).alias("algorithm"),
                (F.col("_column_scores") if "_column_scores" in has else F.create_map().cast("map<string,double>")).alias("column_scores"),
                F.array(*map(F.lit, self.weights)).cast("array<string>").alias("columns"),
                F.col("_score").alias("final_score"),
                F.lit(float(self.boost)).alias("prefix_boost"),
                F.lit(self.term).alias("term"),
                F.lit(self.typos).alias("typo_tolerance"),
                (F.create_map(*[x for c, w in self.weights.items() for x in (F.lit(c), F.lit(float(w)))]) if self.weights else F.create_map()).cast("map<string,double>").alias("weights"),
            )).drop("_column_scores")
        return df

    def _ranked(self, candidates: DataFrame) -> DataFrame:
        df = candidates
        if self.relevance and not (self.query is None and self._empty()):
            df = self._scored(df).orderBy(F.desc("_score"), F.desc_nulls_last("_raw_score"), *self._recall())
        else:
            df = df.orderBy(*self._recall())
        if self.start:
            df = df.offset(self.start)
        return self._decorated(df.limit(self.size))

    def get(self) -> DataFrame:
        """The result page as a lazy DataFrame."""
        if self.cached is not None:
            return self._from_cache()
        s = self._guarded()
        if s is None:
            return self.df.limit(0)
        if s.query is None and s.indexed and not s._empty() and s.store is not None and s.corpus is not None:
            return s._decorated(s._indexed_rows())
        out = s._ranked(s.candidates())
        for i, name in enumerate(self.fallbacks):
            if s.query is not None or not s.matched().isEmpty():
                break
            s = s._(algorithm="simple" if name == "like" else name, fallbacks=self.fallbacks[i + 1 :])
            out = s._ranked(s.candidates())
        return out

    def _scores(self) -> DataFrame | None:
        index = self.store.read(self.corpus)
        if index is None:
            return None
        dictionary = self.store.dictionary() if self.settings.global_df else None
        return bm25.scores(index, self.analyzer.terms(self.term), self.settings, dictionary)

    def _indexed_rows(self, most: int | None = None, start: int | None = None, size: int | None = None) -> DataFrame:
        start, size = self.start if start is None else start, self.size if size is None else size
        scores = self._scores()
        if scores is None:
            return self.df.limit(0)
        best = scores.orderBy(F.desc("score"), "model_id").limit(most or (size + start) * 2)
        top = best.agg(F.max("score").alias("_top"))
        few = (most or (size + start) * 2) <= self.settings.broadcast_rows
        rows = self.df.join(F.broadcast(best) if few else best, F.col(self.key).cast("string") == F.col("model_id")).crossJoin(F.broadcast(top))
        rows = rows.withColumn("_raw_score", F.col("score")).withColumn("_score", F.when(F.col("_top") > 0, F.round(F.col("score") / F.col("_top"), 6)).otherwise(F.col("score")))
        rows = rows.orderBy(F.desc("_raw_score"), "model_id").drop("model_id", "score", "_top")
        return (rows.offset(start) if start else rows).limit(size)

    # -- actions

    def collect(self) -> list[Row]:
        """Runs the search and tells the listeners; the candidates are counted on the way."""
        began = time.perf_counter()
        s = self._guarded()
        if s is None:
            return []
        seen: Any = None
        if s.query is None and s.indexed and s.store is not None and s.corpus is not None:
            rows, name = s.get().collect(), "bm25"
        elif self.cached is not None or self.fallbacks:
            rows, name = self.get().collect(), self._algorithm
        else:
            seen = Observation()
            rows = s._ranked(s.candidates().observe(seen, F.count(F.lit(1)).alias("n"))).collect()
            name = "extended" if s.query is not None else s._algorithm
        event = SearchRan(s.term, tuple(s.weights), name, seen.get["n"] if seen is not None else len(rows), round((time.perf_counter() - began) * 1000, 2))
        for listener in list(_listeners):
            listener(event)
        return rows

    def first(self) -> Row | None:
        return self.take(1).get().first()

    def count(self) -> int:
        return self.matched().count()

    def facet_counts(self) -> DataFrame:
        """facet, value (as text), n over all matching rows, in one pass."""
        if not self.facets:
            return self.df.sparkSession.createDataFrame([], "facet string, value string, n long")
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in self.facets])).alias("f")
        return self.matched().select(pairs).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))

    def get_facets(self) -> dict[str, dict[str | None, int]]:
        out: dict[str, dict[str | None, int]] = {c: {} for c in self.facets}
        for r in self.facet_counts().collect():
            out[r["facet"]][r["value"]] = r["n"]
        return out

    def paginate(self, per_page: int = 15, page: int = 1) -> Page:
        """A page of the recall order, scored within the page, with the number of all matches."""
        if self.query is not None:
            raise NotSupported("boolean queries have no paginate; use simple_paginate or get")
        s = self._guarded()
        if s is None:
            return Page(self.df.limit(0), page, per_page, 0)
        if s.indexed and s.store is not None and s.corpus is not None:
            per_page = min(per_page, s.settings.max_per_page)
            index = s.store.read(s.corpus)
            total = bm25.count(index, s.analyzer.terms(s.term)) if index else 0
            return Page(s._decorated(s._indexed_rows(page * per_page, (page - 1) * per_page, per_page)), page, per_page, total)
        rows = s.matched()
        some = rows.orderBy(*s._recall()).offset((page - 1) * per_page).limit(per_page).coalesce(1)
        return Page(s._(start=0, size=per_page)._ranked(some), page, per_page, rows.count())

    def simple_paginate(self, per_page: int = 15, page: int = 1) -> Page:
        """A page of the final order; has_more tells whether another follows."""
        s = self._(size=per_page + 1, start=(page - 1) * per_page)
        return Page(self._(size=per_page, start=(page - 1) * per_page).get(), page, per_page, None, s.get().count() > per_page)

    def cursor_paginate(self, per_page: int = 15) -> Page:
        raise NotSupported("ranked results have no cursor; use paginate or simple_paginate")

    # -- suggestions

    def suggestions(self, limit: int = 5) -> DataFrame:
        """suggestion: words, and whole values, that begin with the term, from 3 * limit matching rows; shortest first."""
        if len(self.term) < 2 or not self.weights:
            return self.df.sparkSession.createDataFrame([], "suggestion string")
        t = self.term.lower()
        starts = lambda c: F.lower(c).startswith(t)
        rows = self.df.where(reduce(or_, [starts(X.text(c)) for c in self.weights])).orderBy(self.key).limit(3 * limit)
        found = []
        for c in self.weights:
            v = F.coalesce(X.text(c), F.lit(""))
            words = F.filter(F.split(v, r"\s+"), lambda w: starts(w) & (F.length(w) > len(t)))
            found.append(F.concat(words, F.when(starts(v), F.array(v)).otherwise(F.array().cast("array<string>"))))
        each = rows.select(self.key, F.posexplode(F.concat(*found)).alias("pos", "s"))
        kept = each.groupBy(F.lower("s").alias("low")).agg(F.max(F.struct(F.col(self.key), F.col("pos"), F.col("s"))).alias("m"))
        return kept.select(F.col("m.s").alias("suggestion"), "low").orderBy(F.length("suggestion"), "low").limit(limit).select("suggestion")

    def suggest(self, limit: int = 5) -> list[str]:
        """As suggestions, but reading rows only until 2 * limit suggestions are found."""
        if len(self.term) < 2 or not self.weights:
            return []
        t = self.term.lower()
        test = reduce(or_, [F.lower(X.text(c)).startswith(t) for c in self.weights])
        found: dict[str, str] = {}
        for row in self.df.where(test).orderBy(self.key).limit(3 * limit).select(*[X.text(c) for c in self.weights]).collect():
            for v in row:
                if not v or v == "0":
                    continue
                found |= {w.lower(): w for w in re.split(r"\s+", v) if w.lower().startswith(t) and len(w) > len(t)}
                if v.lower().startswith(t):
                    found[v.lower()] = v
            if len(found) >= 2 * limit:
                break
        return sorted(found.values(), key=lambda w: (len(w), w.lower()))[:limit]

    def spellings(self, dictionary: DataFrame, limit: int = 3) -> DataFrame:
        """term, distance, confidence of likely spellings in a dictionary (term, doc_count)."""
        t = self.term.strip().lower()
        n = len(t)
        near = dictionary.where((F.col("term") != t) & F.length("term").between(max(1, n - 3), n + 3) & F.lit(len(self.term) >= 2))
        top = near.orderBy(F.desc("doc_count"), "term").limit(self.settings.spelling_candidates)
        d = top.withColumn("distance", F.levenshtein(F.col("term"), F.lit(t), 3)).where("distance between 1 and 3")
        d = d.withColumn("confidence", F.round(1 - F.col("distance") / F.greatest(F.length("term"), F.lit(n)), 2))
        return d.orderBy(F.desc("doc_count"), "distance", F.desc("confidence"), "term").limit(limit).select("term", "distance", "confidence")

    def did_you_mean(self, limit: int = 3) -> list[dict[str, Any]]:
        """Likely spellings from the store's dictionary; none without a store."""
        if self.store is None or len(self.term) < 2:
            return []
        return [r.asDict() for r in self.spellings(self.store.dictionary(), limit).collect()]

    # -- accounts of the search

    def state_key(self) -> str:
        """A digest of all that determines the result; a new one each time for custom scores."""
        if self.scorer is not None:
            return f"unique-{time.time_ns()}"
        skip = {"df", "store", "cached", "scorer", "analyzer", "settings"}
        state = [(f.name, repr(getattr(self, f.name))) for f in fields(self) if f.name not in skip]
        return hashlib.md5(repr([state, id(self.df), self.settings]).encode()).hexdigest()

    def _from_cache(self) -> DataFrame:
        minutes, key = self.cached
        key = key or self.state_key()
        now = time.time()
        for k in [k for k, (until, _) in _cache.items() if until <= now]:
            _cache.pop(k)[1].unpersist()
        if key not in _cache:
            _cache[key] = (now + 60 * minutes, self._(cached=None).get().persist())
        return _cache[key][1]

    def debug_info(self) -> dict[str, Any]:
        info = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("df", "store", "settings", "analyzer", "scorer")}
        return info | {"algorithm": self._algorithm, "use_cache": self.cached is not None}

    def analytics(self) -> dict[str, Any]:
        return {
            "accent_insensitive": self.accents,
            "algorithm": self._algorithm,
            "cached": self.cached is not None,
            "column_weights": dict(self.weights),
            "columns": self.columns,
            "limit": self.size,
            "offset": self.start,
            "recency_boost": self.recent is not None,
            "stop_words": bool(self.stop_words),
            "synonyms": bool(self.synonyms or self.groups),
            "term": self.term,
            "token_mode": "all" if self.all_tokens else "any",
            "tokenized": self.tokens,
            "typo_tolerance": self.typos,
        }

    def explain(self, mode: str = "formatted") -> None:
        self.get().explain(mode)

    def plan(self) -> str:
        """The optimised plan's text."""
        return self.get()._jdf.queryExecution().optimizedPlan().toString()

    def patterns(self) -> dict[str, list[str]]:
        return P.analysed(self.processed_term())


def render_highlighted(row: Mapping[str, Any] | Row, column: str, tag: str = "mark") -> str:
    """A row's column as HTML, escaped, with its recorded matches in tags."""
    if not _TAG.fullmatch(tag):
        raise ValueError(f"{tag!r} can't be a tag")
    r = row.asDict(True) if isinstance(row, Row) else dict(row)
    value = "" if r.get(column) is None else str(r[column])
    safe = lambda s: html.escape(s).replace("&#x27;", "&#039;")
    out, at = [], 0
    for m in r.get("_matches") or []:
        if m["column"] == column:
            for lo, hi in sorted(m["indices"]):
                out += [safe(value[at:lo]), f"<{tag}>", safe(value[lo : hi + 1]), f"</{tag}>"]
                at = hi + 1
            break
    return "".join([*out, safe(value[at:])])
