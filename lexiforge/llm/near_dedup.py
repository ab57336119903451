"""Operator 3, near-duplicate removal with HyperMinHash.

Method: each shingle hash falls into one of 2**p buckets; per bucket the least remaining hash is kept compressed,
as its count of leading zeros and the r mantissa bits behind them, two bytes in all. Bands of these registers are
the candidate keys. For candidates the share of equal registers, corrected by the number expected to collide by
chance, estimates Jaccard similarity; candidates well below the threshold go, the rest are verified on the full
shingle sets, and one document of each connected group stays (see pairs.py). First each set is compared with the
smallest one of each of its buckets; then, within each bucket, all pairs that this left in different groups. So two
documents with a band in common whose similarity is verified are always in one group.

A document is a doc_id with a text. Defined cases: a null or empty text, or one without words, is in no group, and is
kept. A row with a null doc_id (or one that is no whole number) is kept and in no group. Different texts under one
doc_id are different documents: each is compared, and stays or goes, by itself. Rows equal in doc_id and text are one
document; the one whose columns, as JSON, come first stays. Of a group the smallest doc_id stays, and of its texts in the
group the one of the smallest hash. An empty table gives an empty result. Further columns pass through, whatever their
names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import BROADCAST_KEYS, by_keys, discard, kept, long, map_arrow, map_text, operator, saved, unused, with_small
from lexiforge.llm.pairs import BUCKET, band_edges, check_keys, classes, components, set_keys, shared_bands, text_key, verified
from lexiforge.llm.textops import flat, mix, shingle_sets

SHINGLE, P, R, ROWS, THRESHOLD = 3, 7, 10, 4, 0.5
#: Candidates whose estimate is so far below the threshold are dropped (six standard errors at 128 registers are 0.26).
SLACK = 0.25
#: Registers that are compared in one numpy step.
ACROSS = 1 << 22

SKETCH = "doc_id long, text_key long, n_shingles int, set_key long, check_key long, registers binary, bands array<long>"


def registers(h: np.ndarray, bounds: np.ndarray, p: int = P, r: int = R) -> np.ndarray:
    """The (texts, 2**p) uint16 registers of shingle sets: 1 + (63 - leading zeros) << r | mantissa; 0 where empty."""
    m, n = 1 << p, len(bounds) - 1
    x = mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    slot = doc * m + (x >> np.uint64(64 - p)).astype(np.int64)
    rest = (x << np.uint64(p)) | np.uint64(1)
    least = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, rest)
    seen = np.zeros(n * m, bool)
    seen[slot] = True
    high = np.frexp((least >> np.uint64(11)).astype(np.float64))[1] + 11
    high = np.clip(high, 1, 64)
    bit = (high - 1).astype(np.uint64)
    below = least & ((np.uint64(1) << bit) - np.uint64(1))
    mantissa = np.where(bit >= r, below >> np.maximum(bit, np.uint64(r)) - np.uint64(r), below << (np.uint64(r) - np.minimum(bit, np.uint64(r))))
    lz = 64 - high
    code = (np.minimum(62, 63 - lz).astype(np.uint64) << np.uint64(r)) + mantissa + np.uint64(1)
    return np.where(seen, code, np.uint64(0)).astype(np.uint16).reshape(n, m)


@lru_cache(maxsize=100_000)
def _collisions(n: int, m: int, p: int, r: int) -> float:
    """Expected registers that are equal by chance for disjoint sets of n and m elements."""
    i = np.arange(1, 64 - p)[:, None]
    j = np.arange(1 << r)[None, :]
    low = (1 + j / (1 << r)) * 2.0 ** -(i + p)
    high = low + 2.0 ** -(i + p + r)
    return float((((1 - low) ** n - (1 - high) ** n) * ((1 - low) ** m - (1 - high) ** m)).sum() * (1 << p))


def _rounded(n: int) -> int:
    """n to about 6 %: collisions change slowly with it."""
    return n if n < 16 else int(round(2 ** (round(np.log2(n) * 12) / 12)))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int, p: int = P, r: int = R) -> float:
    """Collision-corrected Jaccard estimate from two register rows and the numbers of shingles behind them."""
    either = int(((a > 0) | (b > 0)).sum())
    if not either:
        return 0.0
    equal = int(((a == b) & (a > 0)).sum())
    chance = _collisions(*sorted((_rounded(n), _rounded(m))), p, r)
    share = max(0.0, equal - chance) / either
    return min(1.0, share)


def _sketch(k: int, p: int, r: int, rows: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, at = shingle_sets(*flat(batch.column("text")), k)
        n, reg = np.diff(at), registers(h, at, p, r)
        groups = reg.reshape(len(reg), -1, rows).astype(np.uint64)
        key = np.zeros(groups.shape[:2], np.uint64)
        for i in range(rows):
            key = mix(key + groups[:, :, i] + np.uint64(1))
        key = mix(key + np.arange(key.shape[1], dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)
        full = groups.any(axis=2)
        offs = np.concatenate(([0], np.cumsum(full.sum(axis=1)))).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offs), pa.array(key[full]))
        raw = pa.array([x.tobytes() for x in reg], pa.binary())
        keys = (pa.array(f(h, at).view(np.int64)) for f in (set_keys, check_keys))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n.astype(np.int32)), *keys, raw, bands], ["doc_id", "text_key", "n_shingles", "set_key", "check_key", "registers", "bands"])

    return run


def _likely(least: float, p: int, r: int):
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("ra", "rb"))
            either = ((x > 0) | (y > 0)).sum(axis=1)
            equal = ((x == y) & (x > 0)).sum(axis=1)
            chance = np.array([_collisions(*sorted((_rounded(n), _rounded(m))), p, r) for n, m in zip(b.column("na").to_pylist(), b.column("nb").to_pylist())])
            ok = np.maximum(0, equal - chance) / np.maximum(1, either) >= least
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _codes(width: int):
    """One byte a register, 0 where empty: equal registers have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, width)
            codes = np.where(x > 0, 1 + x % 255, 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("set_key"), pa.array([c.tobytes() for c in codes], pa.binary())], ["set_key", "codes"])

    return run


def _across(least: float, width: int):
    """Pairs (a, b) of two blocks of a bucket, or of one block with itself, that have different roots and at least this share of equal codes.

    Rows (band, lo, hi, i, set_key, root, codes) come by cell: blocks lo and hi of the band; i is the row's own.
    """

    def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, own, key, root = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("lo", "hi", "i", "set_key", "root"))
        reg = np.concatenate([np.frombuffer(b"".join(r.column("codes").to_pylist()), np.uint8).reshape(-1, width) for r in rows])
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        full, step = (reg > 0).sum(axis=1), max(1, ACROSS // max(1, len(y) * width))
        for at in range(0, len(x), step):
            some = x[at : at + step]
            one, two = reg[some, None], reg[None, y]
            both = ((one > 0) & (two > 0)).sum(axis=2)
            equal = ((one == two) & (one > 0)).sum(axis=2)
            ok = (equal >= least * (full[some, None] + full[None, y] - both)) & (root[some, None] != root[None, y])
            if lo[0] == hi[0]:
                ok &= key[some, None] < key[None, y]
            i, j = np.nonzero(ok)
            a, b = key[some[i]], key[y[j]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    if held and tuple(cell[:, start]) != now:
                        yield from pairs(held)
                        held = []
                    now = tuple(cell[:, start])
                    held.append(batch.slice(start, end - start))
        if held:
            yield from pairs(held)

    return run


def across_pairs(shared: DataFrame, roots: DataFrame, sketches: DataFrame, least: float, p: int, block: int = BUCKET) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a common bucket with different roots, whose registers may be alike; a saved() table.

    A bucket of more than about `block` members is split into blocks by hash, and each pair of blocks is a cell, so that no
    task holds a whole bucket. Registers are compared there, so that pairs that can't be similar are never written.
    """
    rooted = with_small(shared.drop("n"), "set_key", roots).withColumn("root", F.coalesce("root", "set_key"))
    mixed = rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("_a"), F.max("root").alias("_z")).where("_a < _z")
    rows = saved(rooted.join(mixed.select("band", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("nb")).hint("shuffle_merge"), "band"), "mixed")
    nodes = saved(rows.select("set_key").distinct(), "nodes")
    codes = map_arrow(by_keys(sketches.select("set_key", "registers"), "set_key", nodes, True).dropDuplicates(["set_key"]), _codes(1 << p), "set_key long, codes binary")
    own = F.pmod(F.xxhash64("set_key"), F.col("nb")).cast("int").alias("i")
    cells = rows.join(codes, "set_key").select("band", "set_key", "root", "codes", own, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    cells = cells.select("band", F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"), "i", "set_key", "root", "codes")
    cells = cells.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    out = saved(map_arrow(cells, _across(least, 1 << p), "a long, b long").distinct(), "across")
    discard(rows, nodes)
    return out


def _candidates(edges: DataFrame, sketches: DataFrame, least: float, p: int, r: int) -> DataFrame:
    """The edges, a saved() table, whose estimated similarity is at least `least`; a saved() table."""
    nodes = saved(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    sk = kept(by_keys(sketches, "set_key", nodes, True).select("set_key", "n_shingles", "registers").dropDuplicates(["set_key"]))
    pairs = edges.join(sk.toDF("a", "na", "ra"), "a").join(sk.toDF("b", "nb", "rb"), "b")
    out = saved(map_arrow(pairs, _likely(least, p, r), "a long, b long"), "likely")
    sk.unpersist()
    discard(nodes)
    return out


def _grouped(docs: DataFrame, shingle: int = SHINGLE, p: int = P, r: int = R, rows: int = ROWS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Saved() tables: doc_id, text_key, group_id and stays of every document with a near or exact copy; and doc_id and text_key that stand on several rows."""
    docs = docs.select(long("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key())
    drawn = kept(map_text(docs, _sketch(shingle, p, r, rows), SKETCH))
    sketches, reps = classes(drawn)
    bands = sketches.where("doc_id is not null and n_shingles > 0").select("set_key", F.explode("bands").alias("band"))
    shared = shared_bands(bands)
    least = max(0.01, threshold - SLACK)
    edges = saved(band_edges(shared), "edges")
    likely = _candidates(edges, sketches, least, p, r)
    near = verified(docs, reps, likely, shingle, threshold)
    roots = components(near.select("a", "b"))
    discard(edges, likely, near)
    between = across_pairs(shared, roots, sketches, least, p)
    likely = _candidates(between, sketches, least, p, r)
    near = verified(docs, reps, likely, shingle, threshold)
    if not near.isEmpty():
        roots = components(roots.select(F.col("root").alias("a"), F.col("set_key").alias("b")).where("a < b").unionByName(near.select("a", "b")))
    discard(between, likely, near, shared)
    rooted = with_small(reps, "set_key", roots).withColumn("root", F.coalesce("root", "set_key"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("members")).where("members > 1").select("root", "stays")
    sets = saved(rooted.select("set_key", "root").join(whole, "root").select("set_key", "stays"), "sets")
    ids = with_small(sketches.select("doc_id", "text_key", "n_shingles", "set_key").where("doc_id is not null and n_shingles > 0"), "set_key", sets, "inner")
    stays = (F.col("doc_id") == F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))
    groups = saved(ids.select("doc_id", "text_key", F.col("stays.doc_id").alias("group_id"), stays.alias("stays")).distinct(), "groups")
    twice = saved(sketches.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "twice")
    drawn.unpersist()
    discard(reps, roots, sets)
    return groups, twice


@operator
def near_duplicate_groups(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, group_id) of every document that has a near or exact copy; group_id is the smallest id of the group."""
    return _grouped(docs, **params)[0].select("doc_id", "group_id")


@operator
def near_dedup(docs: DataFrame, **params) -> DataFrame:
    """docs without all but the first document of each near-duplicate group; the same columns."""
    groups, twice = _grouped(docs, **params)
    gone = saved(groups.where("not stays").select("doc_id", "text_key"), "gone")
    keys = lambda df: [df["doc_id"].try_cast("long"), F.xxhash64(df["text"].cast("string"))]
    stay = by_keys(docs, keys(docs), gone, False)
    discard(groups)
    if twice.isEmpty():
        return stay
    one, two = unused(docs, "one", "two")
    several = by_keys(stay, keys(docs), twice, True).select("*", *(k.alias(n) for k, n in zip(keys(docs), (one, two))))
    row = F.struct(*docs.columns)
    first = several.groupBy(one, two).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return by_keys(stay, keys(docs), twice, False).unionByName(first)


@operator
def dedup_report(docs: DataFrame, **params) -> DataFrame:
    """One row per document, that is, doc_id and text: doc_id, group_id (itself where it has no copy) and kept (1 or 0)."""
    groups, _ = _grouped(docs, **params)
    ids = docs.select(long("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key")).distinct()
    out = ids.join(F.broadcast(groups) if groups.count() <= BROADCAST_KEYS // 3 else groups, ["doc_id", "text_key"], "left")
    return out.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.when(F.col("stays") == F.lit(False), 0).otherwise(1).alias("kept"))
