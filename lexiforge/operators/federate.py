"""Corpora (tables with their search settings), searches over several of them, lists in memory, and the index engine."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexiforge.config import DEFAULT, Settings
from lexiforge.errors import EmptySearchTerm, SearchError
from lexiforge.functions import expressions as X
from lexiforge.functions.phonetic import similar_text_udf
from lexiforge.operators import bm25
from lexiforge.operators.matching import checked, fuzzy_match_any
from lexiforge.operators.search import Search, likely_columns
from lexiforge.sources.index import Analyzer, IndexStore


@dataclass(frozen=True)
class Corpus:
    """A named table and how to search it; columns are found by their names if none are given.

    searchable=False marks a table without settings of its own, which federated searches match without scores.
    """

    name: str
    df: DataFrame
    key: str = ""
    columns: Mapping[str, float] | Sequence[str] = ()
    algorithm: str | None = None
    typo_tolerance: int | None = None
    stop_words: Sequence[str] = ()
    synonyms: Mapping[str, Sequence[str]] = field(default_factory=dict)
    accent_insensitive: bool = False
    options: Mapping[str, Any] = field(default_factory=dict)
    searchable: bool = True
    settings: Settings = DEFAULT
    store: IndexStore | None = None

    def search(self, term: str) -> Search:
        s = Search(self.df, self.key, self.settings, store=self.store, corpus=self.name).search(term)
        s = s.search_in(self.columns or likely_columns(self.df))
        if self.algorithm:
            s = s.using(self.algorithm)
        if self.typo_tolerance is not None:
            s = s.typo_tolerance(self.typo_tolerance)
        if self.stop_words:
            s = s.ignore_stop_words(self.stop_words)
        if self.synonyms:
            s = s.with_synonyms(self.synonyms)
        if self.accent_insensitive:
            s = s.accent_insensitive()
        return s.options(**self.options)


class Catalog:
    """Corpora by name."""

    def __init__(self):
        self._by_name: dict[str, Corpus] = {}

    def register(self, corpus: Corpus) -> Corpus:
        self._by_name[corpus.name] = corpus
        return corpus

    def corpus(self, name: str) -> Corpus:
        if name not in self._by_name:
            raise SearchError(f"no corpus {name!r}", corpus=name)
        return self._by_name[name]

    def search(self, name: str, term: str) -> Search:
        return self.corpus(name).search(term)


@dataclass(frozen=True)
class Federated:
    """One term over several corpora; rows are tagged with _model_type and ranked together."""

    corpora: tuple[Corpus | None, ...]
    term: str = ""
    columns: tuple[str, ...] = ()
    algorithm: str | None = None
    typos: int = 2
    size: int = 15
    relevance: bool = True

    @classmethod
    def across(cls, *corpora: Corpus | None) -> Federated:
        return cls(corpora)

    def search(self, term: str) -> Federated:
        return replace(self, term=term)

    def search_in(self, columns: Iterable[str]) -> Federated:
        return replace(self, columns=tuple(map(checked, columns)))

    def using(self, algorithm: str) -> Federated:
        return replace(self, algorithm=algorithm)

    def typo_tolerance(self, n: int) -> Federated:
        return replace(self, typos=n)

    def limit(self, n: int) -> Federated:
        return replace(self, size=n)

    def with_relevance(self, on: bool = True) -> Federated:
        return replace(self, relevance=on)

    def options(self, **_: Any) -> Federated:
        """Accepted; corpora have options of their own."""
        return self

    def _one(self, i: int, c: Corpus) -> DataFrame | None:
        if c.searchable:
            s = c.search(self.term).using(self.algorithm or "fuzzy").typo_tolerance(self.typos).with_relevance(self.relevance).limit(self.size)
            found, key = s.get(), s.key
        else:
            columns = [x for x in self.columns or c.columns or ("name", "title") if x in c.df.columns]
            if not columns:
                return None
            key = Search(c.df, c.key).key
            found = c.df.where(fuzzy_match_any(columns, self.term, self.algorithm or "like", c.settings)).orderBy(key).limit(self.size)
        if "_score" not in found.columns:
            found = found.withColumn("_score", F.lit(0.0))
        return found.withColumn("_model_type", F.lit(c.name)).withColumn("_source", F.lit(i)).withColumn("_key", F.col(key).cast("string"))

    def get(self) -> DataFrame:
        """The rows of all corpora, with the columns of each; corpora that are None are passed over."""
        there = [c for c in self.corpora if c is not None]
        if self.term in ("", "0") and not (there and all(c.settings.allow_empty_search for c in there)):
            raise EmptySearchTerm
        parts = [p for i, c in enumerate(there) if (p := self._one(i, c)) is not None]
        if not parts:
            raise SearchError("no corpus has columns to search in")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        order = [F.desc("_score")] if self.relevance else []
        return out.orderBy(*order, "_source", F.desc_nulls_last("_score"), F.length("_key"), "_key").limit(self.size).drop("_source", "_key")

    def counts(self) -> DataFrame:
        """_model_type, n among the rows of get()."""
        return self.get().groupBy("_model_type").agg(F.count("*").alias("n"))

    def grouped(self) -> dict[str, list[Row]]:
        out: dict[str, list[Row]] = {}
        for r in self.get().collect():
            out.setdefault(r["_model_type"], []).append(r)
        return out


@dataclass(frozen=True)
class MemorySearch:
    """A search over a list of dicts, of bounded length, ranked by the best column."""

    df: DataFrame
    term: str = ""
    columns: tuple[str, ...] = ()
    size: int = 15
    start: int = 0
    relevance: bool = True
    settings: Settings = DEFAULT

    @classmethod
    def on(cls, spark: SparkSession, items: Iterable[Mapping[str, Any]] | DataFrame, settings: Settings = DEFAULT) -> MemorySearch:
        if isinstance(items, DataFrame):
            if items.limit(settings.memory_max_items + 1).count() > settings.memory_max_items:
                raise ValueError(f"more than {settings.memory_max_items} items")
            rows = items.withColumn("_at", F.monotonically_increasing_id())
        else:
            items = list(items)
            if len(items) > settings.memory_max_items:
                raise ValueError(f"more than {settings.memory_max_items} items")
            rows = spark.createDataFrame([Row(**x, _at=i) for i, x in enumerate(items)]) if items else spark.createDataFrame([], "_at long")
        return cls(rows, settings=settings)

    def search(self, term: str) -> MemorySearch:
        return replace(self, term=term)

    def search_in(self, columns: Iterable[str]) -> MemorySearch:
        return replace(self, columns=tuple(map(checked, columns)))

    def take(self, n: int) -> MemorySearch:
        return replace(self, size=n)

    def skip(self, n: int) -> MemorySearch:
        return replace(self, start=n)

    def with_relevance(self, on: bool = True) -> MemorySearch:
        return replace(self, relevance=on)

    def __getattr__(self, name: str):
        raise AttributeError(f"searches in memory have no {name}")

    def get(self) -> DataFrame:
        df = self.df
        if self.term and self.columns:
            t = self.term.lower()
            best = []
            for c in self.columns:
                v = F.lower(F.coalesce(X.text(c), F.lit(""))) if c in df.columns else F.lit("")
                cheap = v.contains(t)
                pct = similar_text_udf(F.when(~cheap, F.lit(t)), F.when(~cheap, v))
                best.append(F.when(v == t, 100).when(v.startswith(t), 60).when(cheap, 30).when(pct >= self.settings.memory_min_similarity, F.floor(pct)).otherwise(0).cast("int"))
            df = df.withColumn("_raw_score", F.greatest(*best) if len(best) > 1 else best[0]).where(F.col("_raw_score") > 0)
            df = df.withColumn("_score", F.round(F.col("_raw_score") / F.expr("max(_raw_score) over (partition by 1)"), 6)).orderBy(F.desc("_raw_score"), "_at")
            if not self.relevance:
                df = df.drop("_score", "_raw_score")
        else:
            df = df.orderBy("_at")
        return (df.offset(self.start) if self.start else df).limit(self.size).drop("_at")


class IndexEngine:
    """The verbs of a search engine over an index store; scores are raw BM25 scores."""

    def __init__(self, store: IndexStore, analyzer: Analyzer = Analyzer()):
        self.store, self.analyzer = store, analyzer

    def update(self, c: Corpus) -> int:
        columns = list(c.columns) or list(likely_columns(c.df))
        return self.store.upsert(c.name, c.df, c.search("x").key, columns, self.analyzer)

    def delete(self, name: str, ids: DataFrame) -> None:
        self.store.remove(name, ids)

    def search(self, name: str, query: str, limit: int = 15) -> DataFrame:
        index = self.store.read(name)
        if index is None:
            return self.store.spark.createDataFrame([], "model_id string, score double")
        return bm25.search(index, self.analyzer.terms(query), limit, self.store.settings)

    def paginate(self, name: str, query: str, per_page: int, page: int) -> tuple[DataFrame, int]:
        """The page's results, and the number of all."""
        index = self.store.read(name)
        if index is None:
            return self.search(name, query, per_page), 0
        terms = self.analyzer.terms(query)
        rows = bm25.scores(index, terms, self.store.settings).orderBy(F.desc("score"), "model_id").offset((page - 1) * per_page).limit(per_page)
        return rows, bm25.count(index, terms)

    def map_ids(self, results: DataFrame) -> DataFrame:
        return results.select("model_id")

    def map(self, results: DataFrame, c: Corpus) -> DataFrame:
        """The corpus's rows of the results, best first, with _score."""
        key = c.search("x").key
        return c.df.join(results, F.col(key).cast("string") == F.col("model_id")).withColumnRenamed("score", "_score").orderBy(F.desc("_score"), "model_id").drop("model_id")

    lazy_map = map

    def total_count(self, results: DataFrame) -> int:
        return results.count()

    def flush(self, name: str) -> None:
        self.store.flush(name)

    def create_index(self, name: str) -> None:
        """Nothing to do: an index begins with its first document."""

    delete_index = flush
