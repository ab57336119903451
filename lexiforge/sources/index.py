"""The inverted index: postings, document lengths, term dictionary and totals as DataFrames, and its store.

A version of a corpus's index is a small file, numbered, that lists segments: a base and the changes since, each a set
of tables that is written once. A change writes only its own documents and the ids that it replaces or removes, so its
cost grows with the change; of the index it reads ids and lengths. After some changes the segments are merged. The file
of a version appears whole and only once, so of two writers that start from the same version one has to start
again, and readers never see half of one. Versions stay for a while, for readers that have them open. All statistics are
computed from the documents that are there, and a repeated delivery of changes gives the same state.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.config import DEFAULT, INDEX_STOP_WORDS, Settings
from lexiforge.errors import IndexConflict
from lexiforge.functions import counting
from lexiforge.functions.stems import STEMMERS
from lexiforge.sources.shared import Files

WORD = r"[\p{L}\p{N}]+"
POSTINGS, DOCUMENTS, CONTENT, IDS = "model_id string, term string, frequency int, doc_length long", "model_id string, doc_length long", "model_id string, content long", "model_id string"


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters and digits of at least two characters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), lambda t: F.length(t) >= 2)


def tokenize_term(s: str) -> list[str]:
    """The same for a search term, on the driver."""
    return [t for t in re.findall(r"[^\W_]+", s.lower()) if len(t) >= 2]


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: tokenizer, stop words (compared before stemming), stemmer ("none" or one of STEMMERS)."""

    stop_words: tuple[str, ...] = INDEX_STOP_WORDS["en"]
    stemmer: str = "none"
    max_tokens: int | None = DEFAULT.max_tokens_per_doc
    tokenizer: Callable[[Column], Column] = tokenize
    term_tokenizer: Callable[[str], list[str]] = tokenize_term

    def __post_init__(self):
        if self.stemmer != "none" and self.stemmer not in STEMMERS:
            raise ValueError(f"no stemmer {self.stemmer!r}; there are none, {', '.join(STEMMERS)}")

    def terms(self, text: str) -> list[str]:
        """The distinct terms of a query."""
        words = [t for t in self.term_tokenizer(text) if t not in self.stop_words]
        return list(dict.fromkeys(words if self.stemmer == "none" else map(STEMMERS[self.stemmer], words)))


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # model_id, term, frequency, doc_length
    documents: DataFrame  # model_id, doc_length

    @property
    def terms(self) -> DataFrame:
        """term, doc_count."""
        return self.postings.groupBy("term").agg(F.count("*").alias("doc_count"))

    @property
    def meta(self) -> DataFrame:
        """One row: total_docs, total_tokens, avg_doc_length (0 without documents)."""
        total = self.documents.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("total_tokens"))
        return total.withColumn("avg_doc_length", F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), F.col("total_docs").cast("double")), F.lit(0.0)))


def build(df: DataFrame, key: str, columns: Sequence[str], analyzer: Analyzer = Analyzer()) -> Index:
    """The index of a table's columns. Values null, '' and '0' count for nothing; rows without terms aren't indexed.

    A row stops at the term that would be its max_tokens-th distinct one (None: never). Rows are spread and sorted by key
    before they are taken apart, so that each document is counted as it passes: a task holds the texts that it sorts, which
    can spill, and no table of its terms.
    """
    texts = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit("")).otherwise(F.col(c).cast("string")) for c in columns]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("model_id"), *[t.alias(f"t{i}") for i, t in enumerate(texts)])
    rows = rows.repartition("model_id").sortWithinPartitions("model_id").select("model_id", F.concat(*[analyzer.tokenizer(F.col(f"t{i}")) for i in range(len(texts))]).alias("words"))
    postings = rows.mapInArrow(_counting(analyzer.stop_words, analyzer.stemmer, analyzer.max_tokens), POSTINGS)
    return Index(postings, lengths(postings))


def _counting(stop_words: tuple[str, ...], stemmer: str, max_tokens: int | None):
    """The function of batches; without the analyzer, whose tokenizers stay on the driver."""

    def count(batches):
        try:
            yield from counting.postings(batches, stop_words, STEMMERS.get(stemmer), max_tokens)
        finally:
            pa.default_memory_pool().release_unused()

    return count


def lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("model_id").agg(F.max("doc_length").alias("doc_length"))


def without(index: Index, ids: DataFrame) -> Index:
    """The index without the documents of the one-column table ids."""
    ids = ids.toDF("model_id").select(F.col("model_id").cast("string")).distinct()
    return Index(index.postings.join(ids, "model_id", "left_anti"), index.documents.join(ids, "model_id", "left_anti"))


def merged(index: Index, more: Index) -> Index:
    """The index with `more` in place of the documents of the same ids."""
    old = without(index, more.documents.select("model_id"))
    return Index(old.postings.unionByName(more.postings), old.documents.unionByName(more.documents))


def contents(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """model_id and content, a hash of the columns, to tell whether a document changed."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("model_id"), F.xxhash64(*[F.col(c).cast("string") for c in columns]).alias("h"))
    return rows.groupBy("model_id").agg(F.expr("bit_xor(h)").alias("content"))


class IndexStore:
    """Indexes of several corpora under one path in shared storage."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULT):
        self.spark, self.path, self.settings, self.files = spark, path.rstrip("/"), settings, Files(spark, path)

    # -- versions

    def model_types(self) -> list[str]:
        return [unquote(x) for x in self.files.names("versions") if not self._state(unquote(x))[1].get("flushed", True)]

    def _folder(self, model_type: str) -> str:
        return f"versions/{quote(model_type, '')}"

    def _state(self, model_type: str) -> tuple[int, dict]:
        """The number of the current version (-1: none) and what its file says."""
        names = self.files.names(self._folder(model_type))
        return (int(names[-1]), json.loads(self.files.read(f"{self._folder(model_type)}/{names[-1]}"))) if names else (-1, {})

    def _publish(self, model_type: str, number: int, state: dict) -> None:
        """Makes a state the version of that number; raises IndexConflict where there is one."""
        if not self.files.create(f"{self._folder(model_type)}/{number:012d}", json.dumps(state)):
            raise IndexConflict(model_type, number)
        self.vacuum(model_type, self.settings.keep_versions)

    def vacuum(self, model_type: str, keep: int = 1) -> None:
        """Deletes all versions but the last `keep`, and segments that none of these has."""
        folder = self._folder(model_type)
        names = self.files.names(folder)
        old, live = names[:-keep], names[-keep:]
        if not old:
            return
        segments = lambda n: {s["id"] for s in json.loads(self.files.read(f"{folder}/{n}"))["segments"]}
        used = set().union(*map(segments, live))
        for name in old:
            for gone in segments(name) - used:
                self.files.delete(f"segments/{gone}")
            self.files.delete(f"{folder}/{name}")

    # -- segments

    def _path(self, segment: dict | str, name: str) -> str:
        return f"{self.path}/segments/{segment if isinstance(segment, str) else segment['id']}/{name}"

    def _table(self, segment: dict, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(segment, name))

    def _write(self, index: Index, content: DataFrame | None, removed: DataFrame | None = None) -> tuple[dict, dict]:
        """Writes a segment: postings once, sorted by term for pruning, and the rest from what was written. The segment, and its totals."""
        segment = {"id": uuid.uuid4().hex}
        index.postings.select(*_names(POSTINGS)).hint("rebalance", "term").sortWithinPartitions("term", "model_id").write.parquet(self._path(segment, "postings"))
        written = self._table(segment, "postings", POSTINGS)
        lengths(written).write.parquet(self._path(segment, "documents"))
        documents = self._table(segment, "documents", DOCUMENTS)
        docs, tokens = documents.agg(F.count("*"), F.coalesce(F.sum("doc_length"), F.lit(0))).first()
        for name, df in (("content", content), ("removed", removed)):
            if df is not None:
                df.write.parquet(self._path(segment, name))
            segment[name] = df is not None
        segment["ids"] = docs + (self._table(segment, "removed", IDS).count() if removed is not None else 0)
        return segment, {"docs": docs, "tokens": tokens}

    def _terms(self, segment: dict) -> None:
        """Writes the dictionary of a base segment."""
        terms = self._table(segment, "postings", POSTINGS).groupBy("term").agg(F.count("*").alias("doc_count"))
        terms.sortWithinPartitions("term").write.parquet(self._path(segment, "terms"))

    def _replaced(self, segments: list[dict]) -> DataFrame:
        """model_id of the documents that segments have or remove."""
        parts = [self._table(s, "documents", DOCUMENTS).select("model_id") for s in segments] + [self._table(s, "removed", IDS) for s in segments if s["removed"]]
        ids = reduce(DataFrame.unionByName, parts).distinct()
        return F.broadcast(ids) if sum(s["ids"] for s in segments) <= self.settings.broadcast_rows else ids

    def _live(self, segments: list[dict], name: str, schema: str) -> DataFrame:
        """A table of all segments, without the rows of documents that later segments have or remove."""
        parts = []
        for i, s in enumerate(segments):
            if name == "content" and not s["content"]:
                continue
            rows = self._table(s, name, schema)
            parts.append(rows.join(self._replaced(segments[i + 1 :]), "model_id", "left_anti") if i + 1 < len(segments) else rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    # -- reading

    def read(self, model_type: str) -> StoredIndex | None:
        _, state = self._state(model_type)
        if not state or state["flushed"]:
            return None
        segments = state["segments"]
        postings = self._live(segments, "postings", POSTINGS)
        if len(segments) == 1:
            terms = self.spark.read.schema("term string, doc_count long").parquet(self._path(segments[0], "terms"))
        else:  # a search reads only its own terms of them
            terms = postings.groupBy("term").agg(F.count("*").alias("doc_count"))
        docs, tokens = state["docs"], state["tokens"]
        meta = self.spark.range(1).select(F.lit(docs).cast("long").alias("total_docs"), F.lit(tokens).cast("long").alias("total_tokens"), F.lit(tokens / docs if docs else 0.0).alias("avg_doc_length"))
        return StoredIndex(postings, self._live(segments, "documents", DOCUMENTS), terms, meta)

    # -- writing

    def write(self, model_type: str, index: Index, content: DataFrame | None = None) -> None:
        """Writes a whole index as the corpus's new version."""
        number, _ = self._state(model_type)
        segment, totals = self._write(index, content)
        self._terms(segment)
        self._publish(model_type, number + 1, {"segments": [segment], "flushed": False, **totals})

    def rebuild(self, model_type: str, df: DataFrame, key: str, columns: Sequence[str], analyzer: Analyzer = Analyzer()) -> None:
        self.write(model_type, build(df, key, columns, analyzer), contents(df, key, columns))

    def change(self, model_type: str, new: Index, content: DataFrame | None = None, removed: DataFrame | None = None, tries: int = 5) -> int:
        """Puts documents in the place of those of the same ids, and removes some; returns how many there are in `new`.

        What is written is the change alone. If another writer publishes a version meanwhile, the totals are taken anew.
        """
        number, state = self._state(model_type)
        if not state or state["flushed"]:
            if removed is not None:
                new = without(new, removed)
            self.write(model_type, new, content)
            return self._state(model_type)[1]["docs"]
        segment, totals = self._write(new, content, removed)
        for left in range(tries - 1, -1, -1):
            if state["flushed"]:
                raise IndexConflict(model_type, number)
            ids = self._replaced([segment])
            gone, tokens = self._live(state["segments"], "documents", DOCUMENTS).join(ids, "model_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("doc_length"), F.lit(0))).first()
            after = {"segments": [*state["segments"], segment], "flushed": False, "docs": state["docs"] - gone + totals["docs"], "tokens": state["tokens"] - tokens + totals["tokens"]}
            try:
                self._publish(model_type, number + 1, after)
                break
            except IndexConflict:
                if not left:
                    raise
                number, state = self._state(model_type)
        if len(after["segments"]) > self.settings.merge_segments:
            self.merge(model_type)
        return totals["docs"]

    def merge(self, model_type: str) -> bool:
        """Merges the segments into one; False if there is one only, or if another writer came first."""
        number, state = self._state(model_type)
        if not state or state["flushed"] or len(state["segments"]) < 2:
            return False
        segments = state["segments"]
        postings = self._live(segments, "postings", POSTINGS)
        segment, totals = self._write(Index(postings, lengths(postings)), self._live(segments, "content", CONTENT))
        self._terms(segment)
        try:
            self._publish(model_type, number + 1, {"segments": [segment], "flushed": False, **totals})
        except IndexConflict:
            self.files.delete(f"segments/{segment['id']}")
            return False
        return True

    def upsert(self, model_type: str, df: DataFrame, key: str, columns: Sequence[str], analyzer: Analyzer = Analyzer(), skip_unchanged: bool = False) -> int:
        """Indexes rows anew; returns how many had terms. A row without terms leaves what was indexed for it.

        skip_unchanged: passes over rows whose columns are as they were when they were last indexed.
        """
        content = contents(df, key, columns)
        if skip_unchanged:
            _, state = self._state(model_type)
            if state and not state["flushed"]:
                same = self._live(state["segments"], "content", CONTENT).join(content, ["model_id", "content"], "left_semi").select("model_id")
                df = df.join(same, F.col(key).cast("string") == same["model_id"], "left_anti")
                content = content.join(same, "model_id", "left_anti")
                if content.isEmpty():
                    return 0
        return self.change(model_type, build(df, key, columns, analyzer), content)

    def remove(self, model_type: str, ids: DataFrame) -> None:
        if self.read(model_type):
            ids = ids.toDF("model_id").select(F.col("model_id").cast("string")).where("model_id is not null").distinct()
            none = self.spark.createDataFrame([], POSTINGS)
            self.change(model_type, Index(none, lengths(none)), None, ids)

    def flush(self, model_type: str) -> None:
        """Removes a corpus; the dictionary keeps the terms that other corpora have."""
        number, state = self._state(model_type)
        if state and not state["flushed"]:
            self._publish(model_type, number + 1, {"segments": [], "flushed": True, "docs": 0, "tokens": 0})

    def clear(self) -> None:
        self.files.delete()

    def dictionary(self) -> DataFrame:
        """term and doc_count over all corpora."""
        parts = [self.read(m).terms for m in self.model_types()]
        if not parts:
            return self.spark.createDataFrame([], "term string, doc_count long")
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("doc_count").alias("doc_count"))

    def status(self) -> DataFrame:
        """model_type, total_docs, total_tokens, avg_doc_length and n_terms of each corpus."""
        rows = []
        for m in self.model_types():
            i = self.read(m)
            rows.append(i.meta.crossJoin(i.terms.agg(F.count("*").alias("n_terms"))).withColumn("model_type", F.lit(m)))
        if not rows:
            return self.spark.createDataFrame([], "model_type string, total_docs long, total_tokens long, avg_doc_length double, n_terms long")
        return reduce(DataFrame.unionByName, rows).select("model_type", "total_docs", "total_tokens", "avg_doc_length", "n_terms")


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


class StoredIndex(Index):
    """An index whose dictionary and totals were written with it."""

    def __init__(self, postings: DataFrame, documents: DataFrame, terms: DataFrame, meta: DataFrame):
        super().__init__(postings, documents)
        object.__setattr__(self, "_terms", terms)
        object.__setattr__(self, "_meta", meta)

    @property
    def terms(self) -> DataFrame:
        return self._terms

    @property
    def meta(self) -> DataFrame:
        return self._meta


def content_table(df: DataFrame, model: str, key: str, columns: Sequence[str]) -> DataFrame:
    """The plain search table of earlier versions: model, model_id, content (the columns in one string)."""
    return df.select(F.lit(model).alias("model"), F.col(key).cast("string").alias("model_id"), F.trim(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("content"))
