"""Operator 1, language identification.

Method: multinomial naive Bayes over hashed character n-grams. Counts of a bounded, hash-chosen sample of labelled
documents give a (buckets, languages) matrix of log probabilities, which is broadcast. Scoring sums the matrix rows of
a text's n-grams, for a whole chunk of texts at once in numpy; nothing is computed per row in Python.

N-grams are runs of 1 to 3 characters (code points) of the letters and combining marks of a text, in Unicode lower
case, each gap between words being one blank. The sample has an equal share of each label, so a rare language is in it
however large the table is; of more than LANGUAGES labels the most frequent take part.

Defined cases: a null or empty text, or one without letters, is undetermined ("und"), as is every text where no
labelled document exists; its margin is null. Rows with null labels take no part in training, and equal rows count once.
Ties between languages go to the alphabetically first. Rows with a null doc_id and repeated rows are scored like any
other. An empty table gives an empty result. Further columns pass through (identify, keep_identified), whatever their
names are, or are ignored (language_report). A doc_id that is no whole number is null in the report.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import long, map_text, operator, unused
from lexiforge.llm.textops import flat

#: Most labelled documents that training collects, and most labels.
SAMPLE, LANGUAGES = 3000, 256
BITS, ORDERS, ALPHA = 14, (1, 2, 3), 0.5
#: A declared language counts as refuted if another is more likely by so much in total, and by so much an n-gram.
MARGIN, MARGIN_EACH = 20.0, 0.05
UND = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (len(ORDERS) << BITS, languages), log probabilities
    prior: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower case of every code point that is a letter or a mark, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Letters of all texts, each gap one blank, as hashed n-grams: text numbers and buckets, one array an order."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    c = letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    at = np.searchsorted(lead, offs)  # in code points
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(at))
    letter = c > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character of each gap is its blank
    first = at[:-1][np.diff(at) > 0]
    keep[first] = letter[first]
    c, doc = c[keep].astype(np.uint64), doc[keep]
    code, docs, buckets = c, [], []
    for i, order in enumerate(ORDERS):
        if order > 1:
            code = code[:-1] << np.uint64(21) | c[order - 1 :]
        d = doc[order - 1 :] if order > 1 else doc
        same = d == doc[: len(d)]
        h = (code * MULTIPLIER) >> np.uint64(64 - BITS)
        docs.append(d[same])
        buckets.append(h[same].astype(np.int32) + (i << BITS))
    return docs, buckets


def train(texts: list[str], labels: list[str]) -> Model:
    """Fits the classifier on labelled texts, whole."""
    languages = tuple(sorted(set(labels)))
    size = len(ORDERS) << BITS
    counts = np.zeros((max(1, len(languages)), size))
    number = np.array([languages.index(x) for x in labels], np.int64)
    for at in range(0, len(texts), 200):
        docs, buckets = grams(*flat(pa.array(texts[at : at + 200], pa.string())))
        for d, b in zip(docs, buckets):
            counts += np.bincount(number[at : at + 200][d] * size + b, minlength=counts.size).reshape(counts.shape)
    per_order = counts.reshape(len(counts), len(ORDERS), -1)
    p = (per_order + ALPHA) / (per_order.sum(axis=2, keepdims=True) + ALPHA * per_order.shape[2])
    share = np.bincount(number, minlength=len(counts)) + 1.0
    return Model(languages, np.log(p).reshape(counts.shape).T.astype(np.float32).copy(), np.log(share / share.sum()))


def score(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the best language's number (-1 if undetermined), its margin over the next, and the n-grams counted."""
    n = len(offs) - 1
    sums, total = np.zeros((n, len(model.languages))), np.zeros(n, np.int64)
    if not len(model.languages) or not len(data):
        return np.full(n, -1), np.zeros(n), total
    for d, b in zip(*grams(data, offs)):
        if len(d):
            starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            who = d[starts]
            for l in range(sums.shape[1]):
                sums[who, l] += np.add.reduceat(model.weights[:, l][b], starts, dtype=np.float64)
            total[who] += np.diff(np.append(starts, len(d)))
    sums += model.prior
    best = sums.argmax(axis=1)
    top = sums[np.arange(n), best]
    sums[np.arange(n), best] = -np.inf
    margin = top - sums.max(axis=1) if sums.shape[1] > 1 else np.full(n, np.inf)
    return np.where(total > 0, best, -1), margin, total


def fit(docs: DataFrame, sample: int = SAMPLE, label: str = "lang") -> Model:
    """A model of at most `sample` labelled documents of the whole table, an equal share of each label, chosen by hash."""
    named = docs.where(F.col(label).isNotNull() & (F.col(label) != UND) & F.col("text").isNotNull()).select(F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["label"]: r["count"] for r in named.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()}
    if not sizes:
        return train([], [])
    each = max(1, sample // len(sizes))
    parts = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, 0.9 * each / n) * (1 << 32)))])
    chosen = named.where(F.pmod("h", F.lit(1 << 32)) < F.coalesce(F.try_element_at(parts, F.col("label")), F.lit(0)))
    rows = chosen.groupBy("label", "h").agg(F.min("text").alias("text")).orderBy("h", "label").limit(sample).collect()
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def _apply(model, names: list[str]):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        best, margin, total = score(m, *flat(b.column("text")))
        known = best >= 0
        lang = pa.array([m.languages[i] if i >= 0 else UND for i in best], pa.string())
        margin = pa.array(np.where(np.isfinite(margin), np.round(margin, 3), 0.0), pa.float64(), mask=~known)
        return pa.RecordBatch.from_arrays([*b.columns, lang, margin, pa.array(total)], names)

    return run


def _identified(docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and the names of these: the predicted language, its margin, the n-grams counted."""
    more = unused(docs, "predicted", "margin", "grams")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = docs.select("*", F.lit("").alias(more[0]), F.lit(0.0).alias(more[1]), F.lit(0).cast("long").alias(more[2])).schema
    for f in schema:
        f.nullable = True
    return map_text(docs, _apply(docs.sparkSession.sparkContext.broadcast(model), schema.names), schema), more


@operator
def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with predicted, the language, margin, its log odds over the next, and grams, the n-grams counted.

    Where docs has a column of such a name, the new one has underscores behind it.
    """
    return _identified(docs, model)[0]


def _rejected(label: str, known: tuple[str, ...], more: list[str]):
    lang, margin, n = map(F.col, more)
    refuted = F.col(label).isin(*known) & (lang != F.col(label)) & (margin >= MARGIN) & (margin >= MARGIN_EACH * n)
    return (lang == UND) | F.coalesce(refuted, F.lit(False))


@operator
def keep_identified(docs: DataFrame, sample: int = SAMPLE, label: str = "lang") -> DataFrame:
    """docs without those it rejects: texts of no determined language, and texts that clearly refute their label."""
    model = fit(docs, sample, label)
    out, more = _identified(docs, model)
    return out.where(~_rejected(label, model.languages or (UND,), more)).select(*docs.columns)


@operator
def language_report(docs: DataFrame, sample: int = SAMPLE, label: str = "lang") -> DataFrame:
    """doc_id, declared (the label), predicted, margin and kept (1 or 0) of every row."""
    model = fit(docs, sample, label)
    out, more = _identified(docs.select(long("doc_id"), "text", F.col(label).cast("string").alias("declared")), model)
    return out.select("doc_id", "declared", "predicted", "margin", F.when(_rejected("declared", model.languages or (UND,), more), 0).otherwise(1).alias("kept"))
