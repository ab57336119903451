"""Operator 8, removal of repeated passages by hash-compared suffix sorting.

A passage is repeated where a run of `length` words (white space apart) stands more than once in the corpus. All
occurrences but the first, in the order of (doc_id, position), are cut; what is cut is the union of such runs.

1. Every text is reduced to anchors: the starts of those k-word runs whose hash is least within some window of
   length - k + 1 neighbours. Two equal runs of `length` words contain equal anchors, so texts need to be compared
   only around anchors that occur more than once. About 2 in 27 words are anchors; only their hash, id and
   position are shuffled.
2. Texts with such anchors send the words around each to the partition of the anchor's hash.
3. There the suffixes that start at the anchors are sorted by mergesort. Prefix polynomial hashes let a binary
   search find the common extension of two suffixes, so a comparison takes a logarithmic number of steps. The
   extensions of neighbours are then checked word by word against the text, so hash collisions have no effect.
   The reversed words before the anchors are sorted in the same way. A run of `length` words is equal to another
   exactly if they share the class of their left part and the class of their right part.
4. An anchor of more than LARGE occurrences, such as those of a licence text, is spread over several cells of about that
   size by the hash of (doc_id, position), so that no task holds it alone. Within a cell all but the first occurrence of
   a run are cut as above. The first ones of each cell give the key of the run, without words; keys that several cells
   have are found by a partial aggregation, and only for these the words are gathered, at most once a cell and run,
   streamed in order of occurrence and compared word by word. So the result is the same at every size.

Defined cases: a null or empty text, or one of fewer than `length` words, stays as it is. A row with a null doc_id (or one
that is no whole number), or with a doc_id that stands on rows of different texts, is not compared and stays as it is.
Rows that repeat both doc_id and text are one document: each gets the same cuts. Runs repeated within one text are cut
as well. A text that is a repetition from end to end becomes empty; its row stays. An empty table gives an empty result.
Further columns pass through, whatever their names are. White space before the first kept word goes only in texts that
are cut.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import by_keys, discard, kept, long, map_arrow, map_text, operator, saved, unused
from lexiforge.llm.textops import BASE, INVERSE, IS_SPACE, flat, mix, powers, ragged, run_hash, runs, span_hashes, strings, word_prefix

LENGTH, K = 50, 25
#: Members of anchor groups that are sorted in one step; members of a cell of a larger group, about; and pairs of
#: contexts compared byte for byte at once.
STEP, LARGE, SLICE = 4_000, 16_000, 1_000
TOP = np.iinfo(np.uint64).max


def _slide(x: np.ndarray, w: int, take, pad) -> np.ndarray:
    """take over x[i : i + w] for each i, by doubling."""
    out, have = x.copy(), 1
    while have < w:
        by = min(have, w - have)
        nxt = np.full_like(out, pad)
        if by < len(out):
            nxt[:-by] = out[by:]
        out = take(out, nxt)
        have += by
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: text number, word position and 64-bit hash of each anchor."""
    s, e, at = runs(data, offs, IS_SPACE)
    n, w = len(s), length - k + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    left = at[1:][doc] - np.arange(n)
    pre = word_prefix(span_hashes(data, s, e))
    x = np.full(n, TOP, np.uint64)
    ok = np.flatnonzero(left >= k)
    x[ok] = np.maximum(mix(run_hash(pre, ok, k)), np.uint64(1))
    least = _slide(x, w, np.minimum, TOP)
    least[left < length] = 0
    most = _slide(least[::-1], w, np.maximum, 0)[::-1]
    at_ = np.flatnonzero((most == x) & (left >= k))
    return doc[at_], at_ - at[:-1][doc[at_]], x[at_]


def _anchor_rows(length: int, k: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        d, p, h = anchors(*flat(b.column("text")), length, k)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc_id").take(pa.array(d)), pa.array(p.astype(np.int32))], ["h", "doc_id", "pos"])

    return run


def _contexts(length: int, k: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = flat(b.column("text"))
        s, e, at = runs(data, offs, IS_SPACE)
        lists = b.column("at")
        n = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(b.num_rows), n)
        items = lists.flatten()
        pos, h = items.field("pos").to_numpy().astype(np.int64), items.field("h")
        a = at[:-1][doc] + pos
        first = np.maximum(at[:-1][doc], a - (length - k))
        last = np.minimum(at[1:][doc], a + length)
        size = e[last - 1] - s[first]
        ctx = strings(data[ragged(s[first], size)], np.concatenate(([0], np.cumsum(size))))
        return pa.RecordBatch.from_arrays([h, items.field("cell"), b.column("doc_id").take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array((a - first).astype(np.int32)), ctx], ["h", "cell", "doc_id", "pos", "n_left", "text"])

    return run


class _Suffixes:
    """Suffixes of a word sequence, each of bounded length, whose common extensions are found by prefix hashes."""

    def __init__(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.pre, inverse = word_prefix(words), powers(len(words) + 1, INVERSE)
        self.words, self.start, self.size, self.group = words, start, size, group
        self.low, self.scale = self.pre[start], inverse[start]
        self.steps = int(size.max(initial=0)).bit_length()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that suffixes i and j have in common, by binary search over hashes of their prefixes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        si, sj, li, lj, ci, cj = self.start[i], self.start[j], self.low[i], self.low[j], self.scale[i], self.scale[j]
        for _ in range(self.steps):
            mid = (lo + hi + 1) >> 1
            same = (self.pre[si + mid] - li) * ci == (self.pre[sj + mid] - lj) * cj
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before j: by its first differing word, else the shorter, else the lower number."""
        n = self.extension(i, j)
        ei, ej = n == self.size[i], n == self.size[j]
        last = len(self.words) - 1
        wi, wj = self.words[np.minimum(self.start[i] + n, last)], self.words[np.minimum(self.start[j] + n, last)]
        return np.where(ei | ej, np.where(ei & ej, i < j, ei), wi < wj)

    def sorted(self) -> np.ndarray:
        """Bottom-up mergesort within groups (which stand together): each level merges all pairs of runs at once.

        An element's place is its place in its own run plus its rank in the other, found by binary search.
        """
        n = len(self.start)
        order, m = np.arange(n), 1
        lowest = np.searchsorted(self.group, self.group, "left")
        highest = np.searchsorted(self.group, self.group, "right")
        at = np.arange(n)
        while m < n:
            base = at // (2 * m) * (2 * m)
            split = base + m
            in_left = at < split
            # the part of the other run that belongs to the element's group; ranks outside are known
            other_lo = np.maximum(np.where(in_left, split, base), lowest)
            other_hi = np.minimum(np.where(in_left, base + 2 * m, split), highest)
            act = np.flatnonzero(other_lo < other_hi)
            if len(act):
                me, left, lo, hi = order[act], in_left[act], other_lo[act].copy(), other_hi[act].copy()
                while True:
                    open_ = np.flatnonzero(lo < hi)
                    if not len(open_):
                        break
                    mid = (lo[open_] + hi[open_]) >> 1
                    it = order[mid]
                    before = self.less(it, me[open_])
                    lo[open_] = np.where(before, mid + 1, lo[open_])
                    hi[open_] = np.where(before, hi[open_], mid)
                to = np.where(left, act + (lo - other_lo[act]), act - (other_hi[act] - lo))
                order[to] = me
            m *= 2
        return order

    def neighbours(self, order: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Common extension of each sorted suffix with the one before, checked against the text; -1 where a group starts."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1
        for lo in range(0, len(at), SLICE):
            some = at[lo : lo + SLICE]
            i, j = order[some - 1], order[some]
            n = self.extension(i, j)
            x, y = ragged(self.start[i], n), ragged(self.start[j], n)
            size = e[x] - s[x]
            bad = size != e[y] - s[y]
            bad |= ~_equal(data, s[x], s[y], np.where(bad, 0, size))
            if bad.any():
                pair = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                np.minimum.at(n, pair[bad], offset[bad])
            out[some] = n
        return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of the spans at a and at b, of the given sizes, are the same."""
    differ = data[ragged(a, size)] != data[ragged(b, size)]
    if not differ.any():
        return np.ones(len(size), bool)
    total = np.concatenate(([0], np.cumsum(differ)))
    ends = np.cumsum(size)
    return total[ends] == total[ends - size]


def _classes(group: np.ndarray, n_left: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members whose contexts are byte for byte the same: each member's class, and each class's first member, in order."""
    n, size = len(group), np.diff(offs)
    key = mix(span_hashes(data, offs[:-1], offs[1:]) + mix(group.astype(np.uint64) << np.uint64(8) | n_left.astype(np.uint64)))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    rep = first[which]
    for lo in range(0, n, SLICE):
        m = np.arange(lo, min(lo + SLICE, n))
        f = rep[m]
        same = (size[m] == size[f]) & (group[m] == group[f]) & (n_left[m] == n_left[f])
        same &= _equal(data, offs[:-1][m], offs[:-1][f], np.where(same, size[m], 0))
        rep[m[~same]] = m[~same]
    first, which = np.unique(rep, return_inverse=True)
    return which, first


def repeated_runs(group: np.ndarray, n_left: np.ndarray, data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K, leaders: np.ndarray | None = None):
    """Members (in order of occurrence, groups together) that are not first with some run of `length` words around the anchor.

    Returns their numbers, and from how many words before the anchor to how many after it they are repetitions.
    Members of one and the same context are sorted as one; all of them but the first are repetitions throughout.
    leaders: whether the first member of each run is wanted, by group; they follow, as member, words before, and run hash.
    """
    which, first = _classes(group, n_left, data, offs)
    is_first = first[which] == np.arange(len(which))
    size = np.diff(offs)[first]
    data, offs = data[ragged(offs[:-1][first], size)], np.concatenate(([0], np.cumsum(size)))
    group, n_left = group[first], n_left[first].astype(np.int64)

    s, e, at = runs(data, offs, IS_SPACE)
    words, n = span_hashes(data, s, e), len(group)
    p = at[:-1] + n_left
    right = _Suffixes(words, p, np.minimum(at[1:] - p, length), group)
    r_order = right.sorted()
    r_common = right.neighbours(r_order, data, s, e)
    turned = len(words) - 1 - np.arange(len(words))
    left = _Suffixes(words[::-1].copy(), len(words) - p, n_left, group)
    l_order = left.sorted()
    l_common = left.neighbours(l_order, data, s[turned], e[turned])

    far, near = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    lead: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for l in range(length - k + 1):
        r = length - l
        rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
        rc[r_order] = np.cumsum(r_common < r)
        lc[l_order] = np.cumsum(l_common < l)
        ok = np.flatnonzero((right.size >= r) & (left.size >= l))
        key = rc[ok] * (n + 1) + lc[ok]
        o = np.argsort(key, kind="stable")
        same = np.concatenate((np.zeros(min(1, len(o)), bool), key[o[1:]] == key[o[:-1]]))
        again = ok[o[same]]
        near[again] = np.where(near[again] < 0, l, near[again])
        far[again] = l
        if leaders is not None:
            head = ok[o[~same]]
            head = head[leaders[group[head]]]
            lead.append((first[head], np.full(len(head), l), run_hash(right.pre, p[head] - l, length)))
    low, high = np.maximum(0, length - right.size), np.minimum(left.size, length - k)
    low, high = np.where(low <= high, low, -1), np.where(low <= high, high, -1)
    far, near = np.where(is_first, far[which], high[which]), np.where(is_first, near[which], low[which])
    hit = np.flatnonzero(far >= 0)
    out = hit, far[hit], length - near[hit]
    return out if leaders is None else (*out, *map(np.concatenate, zip(*lead)))


CUTS = "doc_id long, lo int, hi int, h long, l int, run long"


def _cuts(length: int, k: int):
    """Ranges to cut, and, of large groups, the runs that are first in their cell (h is not null there, lo is the anchor)."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        h, cell = b.column("h").to_numpy(), b.column("cell").to_numpy()
        group = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]) | (cell[1:] != cell[:-1]))))
        large = np.zeros(int(group[-1]) + 1, bool)
        large[group] = cell > 0
        pos = b.column("pos").to_numpy().astype(np.int64)
        hit, before, after, head, l, run = repeated_runs(group, b.column("n_left").to_numpy().astype(np.int64), *flat(b.column("text")), length, k, large)
        n, m = len(hit), len(head)
        docs = b.column("doc_id").take(pa.array(np.concatenate((hit, head))))
        lo, hi = np.concatenate((pos[hit] - before, pos[head])), np.concatenate((pos[hit] + after, pos[head]))
        cut = np.arange(n + m) < n
        some = lambda x, kind: pa.array(np.concatenate((np.zeros(n, kind), x.astype(kind, copy=False).view(kind))), mask=cut)
        return pa.RecordBatch.from_arrays([docs, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), some(h[head], np.int64), some(l, np.int32), some(run.view(np.int64), np.int64)], ["doc_id", "lo", "hi", "h", "l", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, about STEP members at once."""
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for b in batches:
            h, cell = b.column("h").to_numpy(), b.column("cell").to_numpy()
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])))
            new[0] = last is None or last != (h[0], cell[0])
            last, at = (h[-1], cell[-1]), 0
            for to in np.flatnonzero(new).tolist():  # here a group ends
                if count + to - at >= STEP:
                    held.append(b.slice(at, to - at))
                    yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, count, at = [], 0, to
            held.append(b.slice(at))
            count += b.num_rows - at
        if count:
            yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _run_words(length: int):
    """The words of runs: of each text, a list `at` of (h, l, run, pos)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = flat(b.column("text"))
        s, e, at = runs(data, offs, IS_SPACE)
        lists = b.column("at")
        doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        items = lists.flatten()
        pos = items.field("pos").to_numpy()
        i = at[:-1][doc] + pos - items.field("l").to_numpy()
        n = np.full(len(i), length)
        size = e[ragged(i, n)] - s[ragged(i, n)]
        words = data[ragged(s[ragged(i, n)], size)]
        # the words and, before them, their sizes: white space doesn't count
        text = pa.array([size[x * length : (x + 1) * length].astype(np.int32).tobytes() + words[a:z].tobytes() for x, (a, z) in enumerate(itertools.pairwise(np.concatenate(([0], np.cumsum(size)))[::length].tolist()))], pa.binary())
        return pa.RecordBatch.from_arrays([items.field("h"), items.field("l"), items.field("run"), b.column("doc_id").take(pa.array(doc)), items.field("pos"), text], ["h", "l", "run", "doc_id", "pos", "words"])

    return run


def _later(length: int):
    """Of rows (h, l, run, doc_id, pos, words) in order, the ranges of those whose words were there before with their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()
        for b in batches:
            docs, lo = [], []
            for *key, doc, pos, words in zip(*(b.column(c).to_pylist() for c in ("h", "l", "run", "doc_id", "pos", "words"))):
                if key != now:
                    now, seen = key, set()
                if words in seen:
                    docs.append(doc)
                    lo.append(pos - key[1])
                seen.add(words)  # one, but for colliding hashes
            lo = np.array(lo, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lo), pa.array(lo + np.int32(length))], ["doc_id", "lo", "hi"])

    return run


def compared(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of the documents that take part, one row each; the ids that stand on several rows, if any."""
    ids = docs.select(long("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    twice = saved(docs.where("doc_id is not null").groupBy(long("doc_id")).count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return ids, None
    several = by_keys(ids, "doc_id", twice, True).distinct()
    unclear = saved(docs.select(long("doc_id"), "text").join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.countDistinct(F.coalesce(F.xxhash64("text"), F.lit(0))).alias("n")).where("n > 1").select("doc_id"), "unclear")
    return by_keys(ids, "doc_id", twice, False).unionByName(by_keys(several, "doc_id", unclear, False)), twice


def _gathered(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The texts that rows name, each with a list `at` of its rows' columns. A list is at most as long as its text."""
    ids = saved(rows.select("doc_id").distinct(), "ids")
    per_doc = rows.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct(*columns)).alias("at"))
    return by_keys(texts, "doc_id", ids, True).join(per_doc.hint("shuffle_merge"), F.col("doc_id") == F.col("id")).drop("id")


def repeated_passages(docs: DataFrame, length: int = LENGTH, k: int = K, large: int = LARGE) -> DataFrame:
    """(doc_id, cuts): of each document with repeated passages, their word ranges (lo, hi), which may overlap; a saved() table."""
    texts, _ = compared(docs)
    rows = kept(map_text(texts, _anchor_rows(length, k), "h long, doc_id long, pos int"))
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    again = kept(rows.join(often.hint("shuffle_merge"), "h").select("h", "doc_id", "pos", "n"))
    # cells are counted from 1 in large groups
    cell = F.when(F.col("n") > large, F.pmod(F.xxhash64("doc_id", "pos"), F.ceil(F.col("n") / F.lit(large))).cast("int") + 1).otherwise(0)
    found = _gathered(texts, again.select("doc_id", "pos", "h", cell.alias("cell")), "pos", "h", "cell")
    ctx = map_text(found, _contexts(length, k), "h long, cell int, doc_id long, pos int, n_left int, text string")
    cuts = map_arrow(ctx.repartition("h", "cell").sortWithinPartitions("h", "cell", "doc_id", "pos"), _cuts(length, k), CUTS)
    hot = not again.where(F.col("n") > large).isEmpty()
    rows.unpersist()
    if hot:
        cuts = saved(cuts, "cuts")
        runs_ = cuts.where("h is not null").select("h", "l", "run", "doc_id", F.col("lo").alias("pos"))
        at = F.struct("doc_id", "pos")
        shared = runs_.groupBy("h", "l", "run").agg(F.min(at).alias("a"), F.max(at).alias("z")).where("a < z").select("h", "l", "run")
        members = kept(runs_.join(shared, ["h", "l", "run"]))
        words = map_text(_gathered(texts, members, "h", "l", "run", "pos"), _run_words(length), "h long, l int, run long, doc_id long, pos int, words binary")
        more = map_arrow(words.repartition("h", "l", "run").sortWithinPartitions("h", "l", "run", "doc_id", "pos"), _later(length), "doc_id long, lo int, hi int")
        ranges = cuts.where("h is null").select("doc_id", "lo", "hi").unionByName(more)
    else:
        ranges = cuts.select("doc_id", "lo", "hi")
    out = saved(ranges.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")), "ranges")
    again.unpersist()
    if hot:
        members.unpersist()
        discard(cuts)
    return out


def cut_words(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts without the given word ranges, as bytes and offsets, and how many words each lost."""
    s, e, at = runs(data, offs, IS_SPACE)
    change = np.zeros(len(s) + 1, np.int64)
    np.add.at(change, at[doc] + lo, 1)
    np.add.at(change, at[doc] + hi, -1)
    keep = np.cumsum(change)[:-1] == 0
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    to = np.append(s[1:], len(data))
    last = at[1:][np.diff(at) > 0] - 1
    to[last] = offs[1:][np.diff(at) > 0]
    size = (to - s)[keep]
    out = np.concatenate(([0], np.cumsum(np.bincount(owner[keep], size, len(offs) - 1)))).astype(np.int64)
    return data[ragged(s[keep], size)], out, np.bincount(owner[~keep], minlength=len(offs) - 1)


def _apply(names: list[str], cuts: str, lost: str):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(cuts)
        items = lists.flatten()
        doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        data, offs, n = cut_words(*flat(b.column("text")), doc, items.field("lo").to_numpy(), items.field("hi").to_numpy())
        cols = {"text": strings(data, offs), lost: pa.array(n.astype(np.int32))}
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else b.column(c) for c in names], names)

    return run


def _without(docs: DataFrame, length: int, k: int, large: int) -> tuple[DataFrame, str]:
    """docs with the cuts made and the number of words lost in one more column, whose name comes with it."""
    ranges = repeated_passages(docs, length, k, large)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    id_, cuts, lost = unused(docs, "cut_id", "cuts", "lost")
    key = docs["doc_id"].try_cast("long")
    hit = ranges.select("doc_id")
    changed = by_keys(docs, [key], hit, True).join(ranges.toDF(id_, cuts).hint("shuffle_merge"), key == F.col(id_)).drop(id_)
    schema = docs.withColumn(lost, F.lit(0)).schema
    rest = by_keys(docs, [key], hit, False).withColumn(lost, F.lit(0))
    return map_text(changed, _apply(schema.names, cuts, lost), schema).unionByName(rest), lost


@operator
def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, large: int = LARGE) -> DataFrame:
    """docs, every row and column, with text cut where it repeats an earlier passage."""
    out, lost = _without(docs, length, k, large)
    out = out.drop(lost)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@operator
def repeats_report(docs: DataFrame, length: int = LENGTH, k: int = K, large: int = LARGE) -> DataFrame:
    """doc_id, text after the cuts, and removed_words of every row."""
    out, lost = _without(docs.select("doc_id", "text"), length, k, large)
    return out.withColumnRenamed(lost, "removed_words")


ORACLE = """
with t as (select doc_id, text, regexp_extract_all(text, '\\S+') w, regexp_extract_all(text, '\\S+\\s*') p from documents),
r as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) k from (select doc_id, w, unnest(range(1, len(w) - 48)) i from t where len(w) >= 50)),
c as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) n from r) where n > 1),
g as (select t.doc_id, u.j, t.p[u.j] piece from t, unnest(range(1, len(t.p) + 1)) u(j)),
x as (select g.doc_id, g.j, g.piece, max(c.i) over (partition by g.doc_id order by g.j rows between 49 preceding and current row) is not null gone
      from g left join c on c.doc_id = g.doc_id and c.i = g.j),
a as (select doc_id, coalesce(string_agg(piece, '' order by j) filter (where not gone), '') s, count(*) filter (where gone) n from x group by doc_id)
select t.doc_id, case when coalesce(a.n, 0) = 0 then t.text else a.s end as text, cast(coalesce(a.n, 0) as integer) as removed_words
from t left join a on a.doc_id = t.doc_id
"""
