"""Words of documents into postings, batch by batch; what is held at a time doesn't grow with a task's share of the table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words handled in one step (one longer row is a step of its own), and stems that a worker remembers from task to task.
STEP_WORDS, MEMO = 1 << 19, 1 << 18
MAX_BYTES = 255
_memos: dict[Callable[[str], str] | None, dict[str, str]] = {}
SCHEMA = pa.schema([("model_id", pa.string()), ("term", pa.string()), ("frequency", pa.int32()), ("doc_length", pa.int64())])


def postings(batches: Iterable[pa.RecordBatch], stop_words: Sequence[str], stem: Callable[[str], str] | None, max_tokens: int | None) -> Iterator[pa.RecordBatch]:
    """model_id, term, frequency, doc_length from rows of model_id and words, in which rows of one id follow each other.

    Stop words go before stemming and long terms after it; then each row stops at its max_tokens-th distinct term.
    """
    stop, memo = pa.array(list(stop_words), pa.string()), _memos.setdefault(stem, {})
    last, held = None, Counter()  # the last document: more of its rows may follow
    for ids, words, sizes in _steps(batches):
        row, code, terms = _terms(words, sizes, stop, stem, memo)
        if max_tokens is not None and len(row) and np.bincount(row).max() >= max_tokens:
            keep = _until(row, code, len(terms), max_tokens)
            row, code = row[keep], code[keep]
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        doc_ids, doc = ids.filter(pa.array(new)), (np.cumsum(new) - 1)[row]
        pairs, counts = np.unique(doc * max(1, len(terms)) + code, return_counts=True)
        doc, code = np.divmod(pairs, max(1, len(terms)))
        docs, first = len(doc_ids), 0
        part = lambda d: dict(zip(terms.take(pa.array(code[(at := slice(*np.searchsorted(doc, [d, d + 1])))])).to_pylist(), counts[at].tolist()))
        if doc_ids[0].as_py() == last:
            held.update(part(0))
            first = 1
        if first < docs:
            yield from _one(last, held)
            at = slice(*np.searchsorted(doc, [first, docs - 1]))
            if at.start < at.stop:
                total = np.bincount(doc[at], counts[at]).astype(np.int64)
                yield _batch(doc_ids.take(pa.array(doc[at])), terms.take(pa.array(code[at])), counts[at], total[doc[at]])
            last, held = doc_ids[docs - 1].as_py(), Counter(part(docs - 1))
    yield from _one(last, held)


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + STEP_WORDS, "right")))
            yield b.column("model_id").slice(at, to - at), b.column("words").slice(at, to - at).flatten(), sizes[at:to]
            at = to


def _terms(words: pa.Array, sizes: np.ndarray, stop: pa.Array, stem: Callable[[str], str] | None, memo: dict[str, str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word that counts, its row and the number of its term; and the terms."""
    coded = words.dictionary_encode()
    terms = coded.dictionary.cast(pa.string())
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = ~pc.is_in(terms, value_set=stop).to_numpy(zero_copy_only=False)
    if stem is not None:
        if len(memo) > MEMO:
            memo.clear()
        found = terms.to_pylist()
        memo.update((w, stem(w)) for w in found if w not in memo)
        stems = pa.array([memo[w] for w in found], pa.string()).dictionary_encode()
        terms, number = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        number = np.arange(len(terms))
    counts &= (pc.binary_length(terms).to_numpy(zero_copy_only=False) <= MAX_BYTES)[number]
    keep = code >= 0
    keep[keep] = counts[code[keep]]
    return np.repeat(np.arange(len(sizes)), sizes)[keep], number[code[keep]], terms


def _until(row: np.ndarray, code: np.ndarray, n_terms: int, most: int) -> np.ndarray:
    """Which words come no later than the most-th distinct one of their row."""
    new = np.zeros(len(row), bool)
    new[np.unique(row * n_terms + code, return_index=True)[1]] = True
    seen = np.cumsum(new)
    starts = np.searchsorted(row, row)
    seen = seen - seen[starts] + 1
    return (seen < most) | ((seen == most) & new)


def _one(doc: str | None, counts: Counter) -> Iterator[pa.RecordBatch]:
    if counts:
        yield _batch(pa.array([doc] * len(counts), pa.string()), pa.array(list(counts), pa.string()), np.array(list(counts.values())), np.full(len(counts), sum(counts.values())))


def _batch(ids: pa.Array, terms: pa.Array, counts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(pa.string()), terms, pa.array(counts.astype(np.int32)), pa.array(lengths.astype(np.int64))], schema=SCHEMA)
