"""Vectorised text primitives over the UTF-8 buffer of an Arrow column.

A chunk of texts is one byte array with row offsets. Words, hashes of words and hashes of word runs come from
prefix sums of polynomial hashes modulo 2**64, so that no Python loop runs over characters or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: ASCII letters count as lower case.
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything of ASCII but letters and digits.
IS_BREAK = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_BREAK[_a:_b] = False

#: Most powers that are kept for later calls, and bytes that are hashed in one step (one longer span is a step of its own).
KEPT, BLOCK = 1 << 21, 1 << 20
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_tables = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to KEPT of them are kept for later calls."""
    had = _tables[base]
    if len(had) < n:
        grown = np.full(max(n, min(2 * len(had), KEPT), 1 << 16), base)
        grown[0] = 1
        had = np.multiply.accumulate(grown)
        if len(had) <= KEPT:
            _tables[base] = had
    return had[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len+1 offsets; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    if arr.buffers()[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(arr.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def runs(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of non-break bytes, and len+1 offsets of each text's runs."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = ~breaks[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] = w[edge]
    end[edge - 1] = w[edge - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hashes of the byte spans, which come in order."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    if n > BLOCK and len(starts) > 1:
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
            low = starts[at]
            out[at:to] = span_hashes(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low, values)
            at = to
        return out
    pw = powers(n + 1)
    pre = np.empty(n + 1, np.uint64)
    pre[0] = 0
    np.cumsum(values[data] * pw[:n], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * powers(n + 1, INVERSE)[starts])


def word_prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash over a word sequence; see run_hash."""
    pre = np.empty(len(h) + 1, np.uint64)
    pre[0] = 0
    np.cumsum(h * powers(len(h) + 1)[: len(h)], out=pre[1:])
    return pre


def run_hash(pre: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hash of `length` words from word `at`, the same wherever that run stands."""
    return (pre[at + length] - pre[at]) * powers(len(pre), INVERSE)[at]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of every text: 44-bit hashes in order, and len+1 offsets.

    Words are runs of letters, digits and non-ASCII bytes, ASCII case folded. A text of 1 to k-1 words has one
    shingle, all its words; a text without words has none.
    """
    s, e, at = runs(data, offs, IS_BREAK)
    n = len(offs) - 1
    counts = np.diff(at)
    pre = word_prefix(span_hashes(data, s, e, FOLDED_VALUE))
    doc = np.repeat(np.arange(n), counts)
    pos = np.arange(len(s))
    size = np.minimum(counts, k)[doc]
    ok = (pos + k <= at[1:][doc]) | (pos == at[:-1][doc])
    doc, pos, size = doc[ok], pos[ok], size[ok]
    h = mix(run_hash(pre, pos, size)) >> np.uint64(20)
    keys = np.unique((doc.astype(np.uint64) << np.uint64(44)) | h)
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))
    return keys & np.uint64((1 << 44) - 1), bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each s, n."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total)
    return out + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)


def strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A string column from bytes and offsets."""
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
