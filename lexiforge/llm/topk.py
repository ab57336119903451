"""Operator 9, exact top-k search by inner product, with norm-bucketed retrieval.

Method: vectors are ordered by length and cut into buckets. A first pass finds, for every query, its k best within the
bucket of the longest vectors; the k-th product is a lower bound, theta. For any other bucket with greatest length m, a
query needs a cosine of theta / (|q| m) there, its local threshold:
  above 1, the query skips the bucket;
  where it is high, coordinate pruning: a unit vector p with cosine t to q has each coordinate within
    q_i t +- sqrt((1 - q_i^2)(1 - t^2)); the candidates of a query lie in these ranges for its largest coordinates;
  else, length pruning: only vectors of at least theta / |q| take part.
Products of the remaining pairs are then verified in double precision, and theta rises with what is found. Pruning never
drops a result (SLACK covers rounding), so the search is exact.

Queries are all rows, or those whose vec_id is divisible by `every`; candidates are all rows. Blocks of both are grouped,
up to GROUP blocks a group, and each pair of groups is a cell of a grid: a task holds one group of queries and reads one of
candidates, block by block. So a block is sent once to each cell of its row or column, not once to each other block.
Cells whose longest candidate is too short for every query of the group are dropped before anything is sent. Nothing is
broadcast.

Defined cases: rows with a null vec_id (or one that is no whole number) or embedding, an empty embedding, or a null, NaN
or infinite component take no part. Vectors of different dimensions are not compared. A query's own vec_id is no result;
of rows with one vec_id the first by components counts. Scores are rounded to 9 decimals and then ranked; ties go to the
smaller vec_id. A query with fewer than k partners gets as many. An empty table gives an empty result. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import discard, long, map_arrow, operator, saved

TOP, BUCKET, GROUP = 10, 2048, 16
#: In the registered query, rows whose id is divisible by this are queries.
EVERY = 20
SLACK = 1e-9
#: Local cosine threshold from which coordinates prune better than lengths; coordinates that are looked at.
HIGH, FOCUS = 0.9, 4

BLOCK = "dim int, bucket int, n int, longest double, ids binary, vectors binary"
FOUND = "vec_id long, match_id long, score double"


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vecs: list[np.ndarray] = []
        dim = None
        number = 0

        def out():
            m = np.array(vecs)
            longest = float(np.sqrt((m * m).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([longest]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["dim", "bucket", "n", "longest", "ids", "vectors"])

        for b in batches:
            flat_ = b.column("v").flatten().to_numpy()
            offs = b.column("v").offsets.to_numpy() - b.column("v").offsets[0].as_py()
            for i, x in enumerate(b.column("vec_id").to_pylist()):
                v = flat_[offs[i] : offs[i + 1]]
                if ids and (len(ids) == size or len(v) != dim):
                    yield out()
                    ids, vecs, number = [], [], number + 1
                dim = len(v)
                ids.append(x)
                vecs.append(v)
        if ids:
            yield out()

    return run


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by rounded score, then id."""
    return np.lexsort((ids, -score))[:k]


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Verified products of paired rows, each as one sum of the same order."""
    return np.round(np.einsum("ij,ij->i", q, p), 9)


def search(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, theta: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its up to k best of the bucket p among products of at least theta: query number, ids, scores."""
    qn, pn = np.sqrt((q * q).sum(axis=1)), np.sqrt((p * p).sum(axis=1))
    longest = pn.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn * longest > 0, theta / (qn * longest), np.where(theta > SLACK, np.inf, -np.inf))
    unit = p / np.where(pn > 0, pn, 1)[:, None]
    skip = local > 1 + 1e-6
    for lo in range(0, len(q), 256):
        rows = np.arange(lo, min(lo + 256, len(q)))
        rows = rows[~skip[rows]]
        coord = rows[(local[rows] >= HIGH) & (qn[rows] > 0)]
        rest = np.setdiff1d(rows, coord, assume_unique=True)
        for i in coord.tolist():
            d, t = q[i] / qn[i], min(1.0, local[i])
            ok = np.ones(len(p), bool)
            for c in np.argsort(-np.abs(d))[:FOCUS]:
                # a longer vector needs less cosine, so the bucket's threshold bounds them all
                wide = np.sqrt(max(0.0, 1 - d[c] * d[c]) * max(0.0, 1 - t * t)) + 1e-7
                top = 1.0 if d[c] >= t else d[c] * t + wide
                low = -1.0 if -d[c] >= t else d[c] * t - wide
                ok &= (unit[:, c] <= top + 1e-7) & (unit[:, c] >= low - 1e-7)
            j = np.flatnonzero(ok & (pid != qid[i]))
            yield from _verified(i, q, qid, p, pid, j, theta[i], k)
        if len(rest):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(qn[rest] > 0, theta[rest] / qn[rest], -np.inf)
            use = np.flatnonzero(pn >= least.min() - 1e-7)
            if not len(use):
                continue
            rough = q[rest] @ p[use].T
            for at, i in enumerate(rest.tolist()):
                r = rough[at]
                j = np.flatnonzero((pid[use] != qid[i]) & (r >= theta[i] - 1e-7))
                if len(j) > k:
                    kth = np.partition(r[j], len(j) - k)[len(j) - k]
                    j = j[r[j] >= kth - 1e-7]
                yield from _verified(i, q, qid, p, pid, use[j], theta[i], k)


def _verified(i, q, qid, p, pid, j, theta, k):
    if len(j):
        s = _products(np.broadcast_to(q[i], (len(j), q.shape[1])), p[j])
        ok = s >= theta - SLACK
        j, s = j[ok], s[ok]
        o = best(pid[j], s, k)
        if len(o):
            yield i, pid[j[o]], s[o]


class _Best:
    """The k best of each query of a block so far, and the bound that a further one has to reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int):
        self.ids, self.q, self.theta, self.k = ids, q, theta.copy(), k
        self.match, self.score = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)

    def add(self, pid: np.ndarray, p: np.ndarray) -> None:
        for i, ids, score in search(self.ids, self.q, pid, p, self.theta, self.k):
            m, s = np.concatenate((self.match[i], ids)), np.concatenate((self.score[i], score))
            o = best(m, s, self.k)
            self.match[i], self.score[i] = m[o], s[o]
            if len(o) == self.k:
                self.theta[i] = max(self.theta[i], s[o[-1]])

    def rows(self) -> pa.RecordBatch:
        who = np.repeat(self.ids, [len(m) for m in self.match])
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate(self.match)), pa.array(np.concatenate(self.score))], ["vec_id", "match_id", "score"])


def _search_cells(k: int):
    """Rows (i, j, kind, dim, ids, vectors, theta) by cell, its queries (kind 0) before its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for n in range(b.num_rows):
                i, j, kind, dim, ids, vectors, theta = (b.column(c)[n].as_py() for c in ("i", "j", "kind", "dim", "ids", "vectors", "theta"))
                if (dim, i, j) != now:
                    yield from (h.rows() for h in held)
                    now, held = (dim, i, j), []
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                if kind == 0:
                    held.append(_Best(ids, m, np.frombuffer(theta, np.float64) if theta else np.full(len(ids), -np.inf), k))
                else:
                    for h in held:
                        h.add(ids, m)
        yield from (h.rows() for h in held)

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the k-th scores found so far, in the order of their ids, and the least length that a candidate needs."""
    for b in batches:
        for n in range(b.num_rows):
            ids = np.frombuffer(b.column("ids")[n].as_py(), np.int64)
            m = np.frombuffer(b.column("vectors")[n].as_py(), np.float64).reshape(len(ids), -1)
            had = {x["vec_id"]: x["theta"] for x in b.column("thetas")[n].as_py() or []}
            theta = np.array([had.get(i, -np.inf) for i in ids.tolist()])
            length = np.sqrt((m * m).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(length > 0, theta / length, np.where(theta > SLACK, np.inf, -np.inf))
            yield pa.RecordBatch.from_arrays([b.column(c).slice(n, 1) for c in ("dim", "block", "ids", "vectors")] + [pa.array([theta.tobytes()], pa.binary()), pa.array([float(need.min()) - 1e-7])], ["dim", "block", "ids", "vectors", "theta", "need"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; partial lists are merged before and after the shuffle."""
    w = "row_number() over (partition by vec_id order by score desc, match_id)"
    return found.withColumn("rank", F.expr(w)).where(F.col("rank") <= k)


def _bucketed(v: DataFrame, bucket: int, what: str) -> DataFrame:
    """The blocks of the vectors in the order of dimension and length, longest first; a saved() table."""
    parts = max(1, -(-v.count() // bucket))
    ordered = v.repartitionByRange(parts, "dim", F.col("norm").desc(), "vec_id").sortWithinPartitions("dim", F.col("norm").desc(), "vec_id")
    return saved(map_arrow(ordered.select("vec_id", "v"), _blocks(bucket), BLOCK).withColumn("block", F.monotonically_increasing_id()), what)


def _cells(q: DataFrame, p: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """What the cells (dim, i, j) find, of query blocks (dim, i, ids, vectors, theta) and candidate blocks (dim, j, ids, vectors)."""
    one = q.join(cells, ["dim", "i"]).select("dim", "i", "j", F.lit(0).alias("kind"), "ids", "vectors", "theta")
    two = p.join(cells, ["dim", "j"]).select("dim", "i", "j", F.lit(1).alias("kind"), "ids", "vectors", F.lit(None).cast("binary").alias("theta"))
    n = max(1, min(cells.count(), 8 * q.sparkSession.sparkContext.defaultParallelism))
    rows = one.unionByName(two).repartition(n, "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "kind")
    return map_arrow(rows.select("i", "j", "kind", "dim", "ids", "vectors", "theta"), _search_cells(k), FOUND)


@operator
def top_k(vectors: DataFrame, k: int = TOP, bucket: int = BUCKET, every: int = 1) -> DataFrame:
    """vec_id, rank (from 1), match_id and score (inner product) of each query's k best partners."""
    v = vectors.select(long("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    v = v.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    v = saved(v, "vectors")
    p = _bucketed(v, bucket, "blocks")
    q = _bucketed(v.where(F.col("vec_id") % every == 0), bucket, "queries") if every > 1 else p
    n_p, n_q, group = p.count(), q.count(), 1
    spread = 16 * v.sparkSession.sparkContext.defaultParallelism
    while group < GROUP and -(-n_p // group) * -(-n_q // group) > spread:
        group *= 2
    number = lambda c: F.floor(F.shiftright(c, 33) / F.lit(group)).cast("long")
    head = p.groupBy("dim").agg(F.max(F.struct("longest", -F.col("block"))).alias("m")).select("dim", (-F.col("m.col2")).alias("block"))
    heads = p.join(head, ["dim", "block"], "left_semi").select("dim", F.lit(0).cast("long").alias("j"), "ids", "vectors")
    first = q.select("dim", F.col("block").alias("i"), "ids", "vectors", F.lit(None).cast("binary").alias("theta"))
    seeds = saved(_ranked(_cells(first, heads, saved(first.select("dim", "i", F.lit(0).cast("long").alias("j")), "cells"), k), k), "seeds")
    theta = seeds.groupBy("vec_id").agg(F.min("score").alias("theta"), F.count("*").alias("n")).where(F.col("n") == k)
    owner = saved(map_arrow(q.select("block", "ids"), _owners, "block long, vec_id long"), "owners")
    lists = theta.join(owner, "vec_id").groupBy("block").agg(F.collect_list(F.struct("vec_id", "theta")).alias("thetas"))
    bound = map_arrow(q.select("dim", "block", "ids", "vectors").join(lists, "block", "left").select("dim", "block", "ids", "vectors", "thetas"), _bounds, "dim int, block long, ids binary, vectors binary, theta binary, need double")
    bound = saved(bound.withColumn("i", number("block")), "bounds")
    rest = p.join(head, ["dim", "block"], "left_anti").withColumn("j", number("block"))
    need, longest = bound.groupBy("dim", "i").agg(F.min("need").alias("need")), rest.groupBy("dim", "j").agg(F.max("longest").alias("longest"))
    cells = saved(need.join(longest, "dim").where(F.col("longest") >= F.col("need")).select("dim", "i", "j"), "cells")
    found = _cells(bound.select("dim", "i", "ids", "vectors", "theta"), rest.select("dim", "j", "ids", "vectors"), cells, k)
    discard(v, owner)
    return _ranked(found.unionByName(seeds.drop("rank")), k).select("vec_id", F.col("rank").cast("int").alias("rank"), "match_id", "score")


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("ids").to_pylist()):
            ids = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], ["block", "vec_id"])


ORACLE = """
with s as (select a.vec_id, b.vec_id match_id, round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) score
           from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by vec_id order by score desc, match_id) n from s)
select vec_id, cast(n as integer) as rank, match_id, score from r where n <= 10
"""
