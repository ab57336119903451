"""Operator 2, document fingerprints: MinHash signatures, joined by bands and verified.

Method: a family of universal hash functions (multiply, add, take the high word) over the distinct word shingles
of each text, evaluated for a whole chunk of texts at once in numpy; the least value per function is the
signature. Documents with one and the same shingle set are a class. Bands of the signatures are joined in Spark: all
pairs of different sets with a band in common are candidates, whose Jaccard similarity is then verified on the full
shingle sets (see pairs.py). Copies are members of a class and never become pairs.

Defined cases: a null or empty text, or one without words, has n_shingles 0, a null signature and class, and no links. A
row with a null doc_id (or one that is no whole number) gets its signature, and no class and links. Repeated rows of one
doc_id each get a row, with the class of their own text; rows equal in doc_id and text are one member of it. A class is
named by its smallest doc_id; where that doc_id has several texts, it may name several classes. Of equally similar
matches the smallest id is reported. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import discard, long, map_text, operator, saved, with_small
from lexiforge.llm.pairs import band_pairs, check_keys, classes, set_keys, shared_bands, text_key, verified
from lexiforge.llm.textops import flat, mix, shingle_sets

SHINGLE, PERMUTATIONS, ROWS, THRESHOLD = 3, 128, 4, 0.5

SKETCH = "doc_id long, text_key long, n_shingles int, set_key long, check_key long, signature array<int>"


def minhash(h: np.ndarray, bounds: np.ndarray, permutations: int, seed: int = 7) -> np.ndarray:
    """The (texts, permutations) signature matrix of shingle sets; a text without shingles has all ones."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, permutations, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(1, 2**63, permutations, dtype=np.uint64)
    out = np.full((len(bounds) - 1, permutations), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    x = mix(h)
    starts, t, got = bounds[full], np.empty_like(x), np.empty((permutations, len(full)), np.uint64)
    for j in range(permutations):
        np.multiply(x, a[j], out=t)
        t += b[j]
        np.minimum.reduceat(t, starts, out=got[j])
    out[full] = (got >> np.uint64(32)).T
    return out


def _sketch(k: int, permutations: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, at = shingle_sets(*flat(batch.column("text")), k)
        n, sig = np.diff(at), minhash(h, at, permutations)
        offs = np.concatenate(([0], np.cumsum(np.where(n > 0, permutations, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(sig[n > 0].view(np.int32).ravel()), mask=pa.array(n == 0)) if len(n) else pa.array([], pa.list_(pa.int32()))
        keys = (pa.array(f(h, at).view(np.int64)) for f in (set_keys, check_keys))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n.astype(np.int32)), *keys, lists], ["doc_id", "text_key", "n_shingles", "set_key", "check_key", "signature"])

    return run


def _linked(docs: DataFrame, shingle: int, permutations: int, rows: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved() tables: the sketches, the classes, and the verified links (a, b, jaccard, id_a, id_b) between these."""
    docs = docs.select(long("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key())
    sketches, reps = classes(saved(map_text(docs, _sketch(shingle, permutations), SKETCH), "sketch"))
    keys = [F.xxhash64(F.lit(i), F.slice("signature", 1 + i * rows, rows)) for i in range(permutations // rows)]
    bands = sketches.where("doc_id is not null and n_shingles > 0").select("set_key", F.explode(F.array(*keys)).alias("band"))
    shared = shared_bands(bands)
    edges = band_pairs(shared)
    discard(shared)
    near = verified(docs, reps, edges, shingle, threshold)
    discard(edges)
    return sketches, reps, near


@operator
def fingerprint_pairs(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The links between classes: class_a, class_b (their smallest doc_ids), jaccard.

    All pairs of classes with a band in common whose Jaccard similarity is at least `threshold`, each once.
    """
    near = _linked(docs, shingle, permutations, rows, threshold)[2]
    return near.select(F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b"), "jaccard")


@operator
def document_fingerprints(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, signature, class_id, n_copies, n_links, match_id, jaccard.

    class_id is the smallest doc_id with the same shingle set, n_copies the number of documents in the class, and n_links
    that of other classes that are linked with it (see fingerprint_pairs). match_id is, of a document that is not the
    class's first, class_id; of the first, the most similar linked class of smaller id; null without such.
    """
    sketches, reps, near = _linked(docs, shingle, permutations, rows, threshold)
    ends = F.array(F.struct("a", "id_a", "id_b"), F.struct(F.col("b").alias("a"), F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    linked = near.select("jaccard", F.explode(ends).alias("e")).select("jaccard", "e.*")
    smaller = F.when(F.col("id_b") < F.col("id_a"), F.struct("jaccard", (-F.col("id_b")).alias("id")))
    links = linked.groupBy("a").agg(F.count("*").alias("n_links"), F.max(smaller).alias("m"))
    info = saved(reps.join(links, F.col("set_key") == F.col("a"), "left").select("set_key", "first", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), "m"), "info")
    discard(near)
    named = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = with_small(sketches.withColumn("set_key", F.when(named, F.col("set_key"))), "set_key", info)
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select(
        "doc_id", "n_shingles", "signature", F.col("first.doc_id").alias("class_id"), F.col("n").alias("n_copies"), F.when(named, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"),
        F.when(is_first, -F.col("m.id")).otherwise(F.col("first.doc_id")).alias("match_id"), F.when(is_first, F.col("m.jaccard")).when(F.col("first").isNotNull(), F.lit(1.0)).alias("jaccard"),
    )
