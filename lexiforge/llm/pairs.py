"""What both near-duplicate operators share: classes of equal sets, candidates from band keys, verification, groups.

A node is one shingle set, named by its set key, 64 bits; documents with one and the same set are one class, so copies
never become pairs. Two documents are candidates if their sets have a band in common; all pairs of a bucket are
compared, in blocks of bounded size, and each counts only once its Jaccard similarity is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import BROADCAST_KEYS, discard, map_arrow, saved, text_chunks, with_small
from lexiforge.llm.textops import flat, mix, shingle_sets

#: Nodes that share a smallest neighbour and are verified in one block, about; members of one block of a bucket, about.
BLOCK, BUCKET = 256, 512
#: Cells that are named beside one text, about; a set with more of them is shingled again for each so many.
CELLS = 1024
#: Edges, of 16 bytes each, that one task joins to components.
FEW = 1_000_000


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An order-free 64-bit key of each shingle set."""
    return _keys(h, bounds, np.uint64(0x51ED2701))


def check_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A second, independent one: what has both equal, and so the same number of shingles, is one set."""
    return _keys(h, bounds, np.uint64(0x7F4A7C15F39CC060))


def _keys(h: np.ndarray, bounds: np.ndarray, salt: np.uint64) -> np.ndarray:
    m = mix(mix(h + salt) ^ salt)
    pre = np.empty(len(m) + 1, np.uint64)
    pre[0] = 0
    np.cumsum(m, out=pre[1:])
    return mix(pre[bounds[1:]] - pre[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64)


def text_key():
    """What tells the texts of one doc_id apart."""
    return F.xxhash64("text").alias("text_key")


def classes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sketches, and a saved() table with one row of each shingle set: set_key, first (its smallest doc_id and text_key) and n.

    A partial aggregation: no list of members is ever built. Texts without shingles or with a null id are left out.
    Where sets that differ in their check key have one set key, they get new keys in both.
    """
    named = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    each = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n"), F.min("check_key").alias("_a"), F.max("check_key").alias("_z"))
    reps = saved(each, "reps")
    two = reps.where("_a < _z").select("set_key", F.lit(True).alias("two"))
    if two.isEmpty():
        return sketches, reps.drop("_a", "_z")
    key = F.when(F.col("two"), F.xxhash64("set_key", "check_key")).otherwise(F.col("set_key"))
    return classes(with_small(sketches, "set_key", two).withColumn("set_key", key).drop("two").select(*sketches.columns))


def shared_bands(bands: DataFrame) -> DataFrame:
    """(band, set_key, n) of the bands, rows (set_key, band), that n > 1 different sets have; a saved() table.

    Nearly all bands stand on one row only; they go before the rest is made distinct and counted.
    """
    often = bands.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1").select("band")
    rows = saved(bands.join(often.hint("shuffle_merge"), "band").distinct(), "bands")
    many = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    out = saved(rows.join(many.hint("shuffle_merge"), "band").select("band", "set_key", "n"), "shared")
    discard(rows)
    return out


def band_pairs(shared: DataFrame, block: int = BUCKET) -> DataFrame:
    """Distinct candidate edges (a, b), a < b, from rows (band, set_key, n) of shared_bands(): all pairs of each bucket.

    A bucket of more than about `block` members is split into blocks by hash; each pair of its blocks is a row, so that
    no task holds a whole bucket. The result is a saved() table.
    """
    rows = shared.withColumn("nb", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("i", F.pmod(F.xxhash64("set_key"), F.col("nb")).cast("int"))
    blocks = saved(rows.groupBy("band", "nb", "i").agg(F.sort_array(F.collect_list("set_key")).alias("m")), "blocks")
    within = blocks.where(F.size("m") > 1).select("m", F.posexplode("m").alias("p", "x")).select("x", F.explode(F.slice("m", F.col("p") + 2, F.size("m"))).alias("y"))
    split = blocks.where("nb > 1")
    left = split.where("i + 1 < nb").select("band", "m", F.explode(F.sequence(F.col("i") + 1, F.col("nb") - 1)).alias("j"))
    between = left.join(split.select("band", F.col("i").alias("j"), F.col("m").alias("other")), ["band", "j"]).select(F.explode("m").alias("x"), "other").select("x", F.explode("other").alias("y"))
    both = within.unionByName(between)
    out = saved(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    discard(blocks)
    return out


def band_edges(shared: DataFrame) -> DataFrame:
    """Distinct candidate edges (a, b), a < b, from the same rows: each set with the first of its bucket."""
    hubs = shared.groupBy("band").agg(F.min("set_key").alias("a"))
    return shared.join(hubs.hint("shuffle_merge"), "band").where(F.col("set_key") > F.col("a")).select("a", F.col("set_key").alias("b")).distinct()


def _pack(h: np.ndarray) -> bytes:
    """44-bit numbers in 6 bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sets(k: int):
    """The shingle set of each text, once a task for each part of the set's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in text_chunks(batches):
            at = [i for i, x in enumerate(zip(b.column("set_key").to_pylist(), b.column("part").to_pylist())) if not (x in seen or seen.add(x))]
            if not at:
                continue
            b = b.take(pa.array(at))
            h, cut = shingle_sets(*flat(b.column("text")), k)
            words = [_pack(h[cut[i] : cut[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("cells"), b.column("set_key"), b.column("doc_id"), pa.array(words, pa.binary())], ["cells", "a", "doc_id", "words"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            a, b, j, id_a, id_b = [], [], [], [], []
            for cell, x, y, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if cell != now:
                    now, sets = cell, {}
                if y is None:
                    sets[x] = doc, _unpack(raw.as_py())
                    continue
                (doc, one), (other, two) = sets[x], sets[y]
                both = len(np.intersect1d(one, two, assume_unique=True))
                sim = both / max(1, len(one) + len(two) - both)
                if sim >= least:
                    a.append(x), b.append(y), j.append(sim), id_a.append(doc), id_b.append(other)
            whole = (pa.array(v, pa.int64()) for v in (id_a, id_b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64()), *whole], ["a", "b", "jaccard", "id_a", "id_b"])

    return run


def verified(docs: DataFrame, reps: DataFrame, edges: DataFrame, k: int, least: float) -> DataFrame:
    """Edges (a, b, jaccard, id_a, id_b) whose exact Jaccard similarity over k-word shingles is at least `least`, with the first doc_id of each set.

    docs has (doc_id, text_key, text), reps is a saved() table of classes(), edges one of set keys. Only the first
    document of each set that an edge names is shingled again. Nodes fall into blocks of about BLOCK by their smallest
    neighbour; a set is sent once to each pair of blocks with an edge of it, not once to each edge, and straight from the
    text: what cells it goes to is joined to its document's id. Repeated rows of one document are shingled once a task.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = both.groupBy("a").agg(F.min("b").alias("r")).select(F.col("a").alias("id"), F.least("a", "r").alias("root"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK)))
    nodes = saved(roots.join(sizes, "root", "left").select("id", F.xxhash64("root", part).alias("block")), "nodes")
    few = nodes.count() <= BROADCAST_KEYS // 3
    small = lambda df: F.broadcast(df) if few else df.hint("shuffle_merge")
    two = edges.join(small(nodes.toDF("a", "one")), "a").join(small(nodes.toDF("b", "two")), "b")
    cells = saved(two.select("a", "b", F.xxhash64(F.least("one", "two"), F.greatest("one", "two")).alias("cell")), "cells")
    need = saved(cells.select("cell", F.explode(F.array("a", "b")).alias("set_key")).distinct(), "need")
    parts = need.groupBy("set_key").agg(F.ceil(F.count("*") / F.lit(CELLS)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int").alias("part")
    lists = need.join(parts, "set_key").groupBy("set_key", part).agg(F.collect_list("cell").alias("cells"))
    small = F.broadcast if need.count() <= BROADCAST_KEYS // 3 else lambda df: df.hint("shuffle_merge")
    ids = reps.join(small(lists), "set_key").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "set_key", "part", "cells")
    texts = docs.join(small(ids), ["doc_id", "text_key"]).select("set_key", "part", "cells", "doc_id", "text")
    sets = map_arrow(texts, _sets(k), "cells array<long>, a long, doc_id long, words binary")
    full = sets.select(F.explode("cells").alias("cell"), "a", F.lit(None).cast("long").alias("b"), "doc_id", "words")
    rows = full.unionByName(cells.select("cell", "a", "b", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("words")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())
    out = saved(map_arrow(rows, _verify(least), "a long, b long, jaccard double, id_a long, id_b long"), "verified")
    discard(nodes, cells, need)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges (a, b), every node and the smallest one connected with it."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root != root[root]).any():
            root = root[root]
    for lo in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + (1 << 16)]), pa.array(ids[root[lo : lo + (1 << 16)]])], ["set_key", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(set_key, root) of every node in the edges (a, b), a saved() table: root is the smallest one connected with it.

    Up to `few` edges are joined by one task. More go through alternating large-star and small-star steps; each is saved, and
    the loop ends when the edges no longer change. The minimum of a node's neighbours is a partial aggregation that is
    joined back, where AQE splits the keys of large stars.
    """
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "star")
    if now.count() <= few:
        out = saved(map_arrow(now.repartition(1), _joined, "set_key long, root long"), "roots")
        discard(now)
        return out
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        new = saved(small.select(F.col("e.m").alias("a"), F.col("e.u").alias("b")).where("a < b").distinct(), "star")
        discard(now)
        now, last = new, mark
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == last:
            return now.select(F.col("b").alias("set_key"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("set_key"), F.col("a").alias("root")).distinct())
