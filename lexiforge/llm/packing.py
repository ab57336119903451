"""Operator 4, packing of documents into training windows of bounded length, in order.

Method: the documents, in the order of doc_id, form one sequence of sentences, whose lengths are counted in tokens of
the byte-pair encoding (operator 5). Windows are consecutive sentences; dynamic programming chooses the cuts. With P the
running token count, a window from cut i to cut j costs
  capacity - (P[j] - P[i])                 padding, if it fits,
  truncation * (P[j] - P[i] - capacity)    for the tokens that are lost, if it does not,
  + inside                                 if cut j lies within a document.
A fitting window starts at a cut with P[i] >= P[j] - capacity, so the best one is the minimum of best[i] + P[i] in a
window that only moves forward: a monotone queue keeps it, and each cut enters and leaves the queue once. For windows
that do not fit, the minimum of best[i] - truncation * P[i] over the cuts that left is kept. All is linear.

Shards bound what one task holds: a shard is the documents that begin within one range of `shard` tokens of the whole
sequence, so it has the same amount of tokens whatever the ids are. No window crosses a shard, which costs less than one
window's padding in `shard` tokens (0.05 % with 2 ** 22).

1. Texts are encoded and written once, with their sentence lengths, tokens as 2- or 4-byte numbers.
2. Only (doc_id, text hash, row number, token count) are sorted over all documents, and added up; the first document of
   each shard is a bound. Bounds are counted: up to LIMIT of them are broadcast and each row finds its shard by binary
   search; beyond that, rows are joined with their shard.
3. The tokens are shuffled once, by shard, and cut into windows.

A sentence ends with . ! or ? before white space, or before a line break, at the next boundary between pieces of the
encoding; so tokens are never split, and the tokens of all windows, with what was truncated, are those of all texts.

Defined cases: a null or empty text is one sentence of 0 tokens, so every document belongs to a window. Null doc_ids (and
ids that are no whole numbers) come first. Rows with the same doc_id stand next to each other, by text hash. Of equally
cheap cuts the earliest start wins. A sentence longer than the capacity gets a window, and its tokens beyond the capacity
count as truncated. A document longer than a shard is in one shard as a whole. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import discard, long, map_arrow, map_text, operator, saved
from lexiforge.llm.bpe import CHUNK, coder, encode_pieces, worker_memo
from lexiforge.llm.textops import IS_SPACE, flat

CAPACITY, SHARD, TRUNCATION, INSIDE = 2048, 1 << 22, 4, 32
#: Most bounds of shards that are broadcast, at 24 bytes each.
LIMIT = 1_000_000

_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
SCHEMA = "shard long, window int, first_doc long, first_sentence int, last_doc long, last_sentence int, n_tokens int, padding int, truncated int, doc_ids array<long>, tokens array<int>"


def sentences(data: np.ndarray, offs: np.ndarray, piece: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of the sentences of every text, and len+1 offsets; a text has at least one sentence.

    piece: byte starts of the pieces; tokens: their len+1 token offsets; at: len+1 piece offsets of the texts.
    """
    n = len(offs) - 1
    if not len(data):
        return np.zeros(n, np.int64), np.arange(n + 1)
    cut = data == 10  # a cut lies before the byte
    cut[1:] |= IS_SPACE[data[1:]] & _ENDS[data[:-1]]
    cut[offs[:-1][np.diff(offs) > 0]] = False
    # at the first piece from there on; a cut in the last piece of a text falls on the text's end
    inner = np.unique(np.searchsorted(piece, np.flatnonzero(cut)))
    inner = inner[~np.isin(inner, at)]
    text = np.searchsorted(at, inner, "right") - 1
    count = np.bincount(text, minlength=n) + 1
    to = np.concatenate(([0], np.cumsum(count)))
    begin = np.empty(to[-1] + 1, np.int64)
    begin[to[:-1]] = tokens[at[:-1]]
    begin[-1] = tokens[at[-1]]
    begin[np.arange(len(inner)) + text + 1] = tokens[inner]
    return np.diff(begin), to


def best_cuts(sizes: list[int], doc_end: list[bool], capacity: int, truncation: int, inside: int) -> tuple[list[int], int]:
    """The ends (exclusive) of the cheapest windows over the sentences, and their cost."""
    n = len(sizes)
    best, back, total = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for j in range(n):
        total[j + 1] = total[j] + sizes[j]
    queue: deque[int] = deque()
    lost, lost_at = None, -1
    for j in range(1, n + 1):
        i = j - 1
        key = best[i] + total[i]
        while queue and best[queue[-1]] + total[queue[-1]] > key:
            queue.pop()
        queue.append(i)
        least = total[j] - capacity
        while queue and total[queue[0]] < least:
            queue.popleft()
        # cuts that a window to j would overfill: all i before `over`
        while lost_at + 1 < j and total[lost_at + 1] < least:
            lost_at += 1
            k = best[lost_at] - truncation * total[lost_at]
            if lost is None or k < lost[0]:
                lost = (k, lost_at)
        cost = None
        if lost is not None:
            cost, back[j] = lost[0] + truncation * (total[j] - capacity), lost[1]
        if queue:
            fits = best[queue[0]] + total[queue[0]] + capacity - total[j]
            if cost is None or fits < cost or fits == cost and queue[0] < back[j]:
                cost, back[j] = fits, queue[0]
        best[j] = cost + (0 if doc_end[j - 1] else inside)
    ends = []
    j = n
    while j > 0:
        ends.append(j)
        j = back[j]
    return ends[::-1], best[n]


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))


def _encoded(shared):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = shared.value
        data, offs = flat(b.column("text"))
        tokens, piece, number, at = encode_pieces(v, data, offs, worker_memo(v))
        raw = tokens.astype(np.uint16 if v.size <= 1 << 16 else np.uint32)
        sizes, to = sentences(data, offs, piece, number, at)
        bounds = (number[at] * raw.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), _lists(sizes.astype(np.int32), to), pa.array(np.diff(number[at])), packed], ["doc_id", "tie", "sizes", "n", "packed"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows their partition's number and the tokens before them in it."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        total = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(total - n)], [*b.schema.names, "part", "before"])
        before = int(total[-1]) if len(n) else before


def _order(doc: np.ndarray, null: np.ndarray, tie: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A structured array that sorts by null doc_ids first, doc_id, tie and row."""
    out = np.empty(len(doc), [("some", np.int8), ("doc", np.int64), ("tie", np.int64), ("row", np.int64)])
    out["some"], out["doc"], out["tie"], out["row"] = ~null, np.where(null, 0, doc), tie, row
    return out


def _keys(b: pa.RecordBatch) -> np.ndarray:
    doc = b.column("doc_id")
    return _order(doc.fill_null(0).to_numpy(), ~doc.is_valid().to_numpy(zero_copy_only=False), b.column("tie").to_numpy(), b.column("row").to_numpy())


def _sharded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, shards = shared.value
        for b in batches:
            yield b.append_column("shard", pa.array(shards[np.searchsorted(bounds, _keys(b), "right") - 1]))

    return run


def _shards(encoded: DataFrame, shard: int, limit: int) -> DataFrame:
    """encoded with the shard of each row."""
    spark = encoded.sparkSession
    light = encoded.select("doc_id", "tie", "row", "n")
    ordered = light.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    summed = saved(map_arrow(ordered, _summed, "doc_id long, tie long, row long, n long, part int, before long"), "sums")
    totals = sorted(map(tuple, summed.groupBy("part").agg(F.max(F.col("before") + F.col("n"))).collect()))  # a row a partition
    at = dict(zip((p for p, _ in totals), np.concatenate(([0], np.cumsum([t for _, t in totals])))[:-1].tolist()))
    offsets = F.broadcast(spark.createDataFrame(list(at.items()), "part int, offset long"))
    placed = summed.join(offsets, "part").select("doc_id", "tie", "row", F.floor((F.col("offset") + F.col("before")) / F.lit(shard)).cast("long").alias("shard"))
    firsts = saved(placed.groupBy("shard").agg(F.min(F.struct("doc_id", "tie", "row")).alias("k")).select("shard", "k.*"), "bounds")
    if firsts.count() <= limit:
        b = firsts.toArrow()
        discard(firsts, summed)
        keys = _order(b["doc_id"].fill_null(0).to_numpy(), ~b["doc_id"].is_valid().to_numpy(), b["tie"].to_numpy(), b["row"].to_numpy())
        by = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[by], b["shard"].to_numpy()[by]))
        return map_arrow(encoded, _sharded(shared), "doc_id long, tie long, sizes array<int>, n long, packed binary, row long, shard long")
    return encoded.join(placed.select("row", "shard").hint("shuffle_merge"), "row")


def _pack(capacity: int, truncation: int, inside: int):
    def shard_rows(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        shard = t["shard"][0].as_py()
        docs, sizes = t["doc_id"].combine_chunks(), t["sizes"].combine_chunks()
        per_doc = np.diff(sizes.offsets.to_numpy())
        sizes = sizes.flatten().to_numpy()
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        raw = b"".join(t["packed"].to_pylist())
        tokens = np.frombuffer(raw, np.uint16 if 2 * sizes.sum() == len(raw) else np.uint32)
        ends = np.append(owner[1:] != owner[:-1], True)
        cuts, _ = best_cuts(sizes.tolist(), ends.tolist(), capacity, truncation, inside)
        total = np.concatenate(([0], np.cumsum(sizes)))
        to = np.array(cuts)
        at = np.concatenate(([0], to[:-1]))
        n = total[to] - total[at]
        first, last = owner[at], owner[to - 1]
        for lo in range(0, len(to), 256):
            w = np.arange(lo, min(lo + 256, len(to)))
            used, ids = np.minimum(n[w], capacity), last[w] - first[w] + 1
            some = np.concatenate([tokens[total[a] : total[a] + k] for a, k in zip(at[w], used)]).astype(np.int32)
            members = docs.take(pa.array(np.concatenate([np.arange(a, b + 1) for a, b in zip(first[w], last[w])])))
            columns = [
                pa.array(np.full(len(w), shard)), pa.array(w.astype(np.int32)), docs.take(pa.array(first[w])), pa.array(number[at[w]].astype(np.int32)), docs.take(pa.array(last[w])), pa.array(number[to[w] - 1].astype(np.int32)),
                pa.array(used.astype(np.int32)), pa.array(np.maximum(0, capacity - n[w]).astype(np.int32)), pa.array(np.maximum(0, n[w] - capacity).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ids))).astype(np.int32)), members), _lists(some, np.concatenate(([0], np.cumsum(used)))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            s = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and s[lo] != now:
                        yield from shard_rows(held)
                        held = []
                    now = s[lo]
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from shard_rows(held)

    return run


@operator
def pack(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, shard: int = SHARD, truncation: int = TRUNCATION, inside: int = INSIDE, limit: int = LIMIT) -> DataFrame:
    """The windows: shard, window (from 0 in each shard), first and last document and sentence, n_tokens, padding, truncated, doc_ids, tokens.

    ranks_path: the vocabulary of the encoding. tokens has the window's n_tokens tokens, padding not included.
    """
    texts = docs.select(long("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = map_text(texts, _encoded(coder(docs, ranks_path)), "doc_id long, tie long, sizes array<int>, n long, packed binary", CHUNK)
    encoded = saved(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")
    sharded = _shards(encoded, shard, limit).select("shard", "doc_id", "tie", "row", "sizes", "packed")
    return map_arrow(sharded.repartition("shard").sortWithinPartitions("shard", "doc_id", "tie", "row"), _pack(capacity, truncation, inside), SCHEMA)
