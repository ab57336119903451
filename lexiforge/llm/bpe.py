"""Operator 5, byte-pair encoding and decoding with a given vocabulary of ranks.

Method: contiguous rank arrays. A word is its byte parts and the ranks of its adjacent pairs, side by side in arrays;
the least rank is searched by scanning, the boundary there is deleted, and the ranks to its left and right are
refreshed, until no pair has a rank. The words stand one after the other in the arrays, so that each step treats all of
them in numpy, and those that are done leave. Only the distinct words of a chunk are encoded, and each worker remembers
up to MEMO of them. A word of over LONG bytes is merged with a heap instead, to the same result, since scanning it would
take quadratic time.

Texts are first split as by the public pattern of the rank files
('s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+), which is evaluated from the
boundaries of character classes, without a regular expression. No special tokens are produced.

Defined cases: a null or empty text has no tokens. Null doc_ids and repeated rows are treated like any other row.
Strings of special tokens are ordinary text. Ties of rank go to the leftmost pair. An empty table gives an empty
result. A doc_id that is no whole number counts as null. Further columns are ignored (bpe_encode) or pass through
(bpe_decode, which gives the text in `decoded`, or `decoded_` if there is such a column). A null list of tokens decodes
to an empty text; a null within one, or a number that is no token, stands for nothing.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import long, map_arrow, map_text, operator, unused
from lexiforge.llm.textops import flat, ragged, span_hashes

LONG, MEMO, CHUNK = 64, 150_000, 1 << 19
#: The rank of a pair that doesn't merge.
NONE = np.int32(2**31 - 1)
#: The rank file that queries and the pipeline use; LEXIFORGE_RANKS names another.
RANKS = os.environ.get("LEXIFORGE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Rank tables as arrays, to be broadcast: single bytes, pairs of tokens (open addressing), and token bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.full(256, -1, np.int64)
        for i in range(256):
            self.bytes[i] = ranks.get(bytes([i]), -1)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key, rank = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & (len(self.keys) - 1)
        self.bytes = self.bytes.astype(np.int32)
        #: Ranks of the pairs of bytes, which every word starts with.
        self.byte_pairs = self.pair(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))
        self.size = size = max(ranks.values()) + 1
        words = [b""] * size
        for token, r in ranks.items():
            words[r] = token
        self.offsets = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        self.text = np.frombuffer(b"".join(words), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NONE where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], NONE)
        on = np.flatnonzero((there != key) & (there >= 0))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == key[on]
            out[on[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there >= 0)
            on, slot = on[go], slot[go]
        return out


def merge_short(v: Vocabulary, text: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Encodes words of at least a byte, which stand one after the other in `text`: their numbers, tokens and token counts, of words that end together.

    A step merges the leftmost pair of the least rank of every word that has one.
    """
    parts, words, done = v.bytes[text], np.arange(len(size)), []
    ranks = np.full(len(text), NONE, np.int32)  # of each part with the next one of its word
    ranks[:-1] = v.byte_pairs[text[:-1].astype(np.int32) << 8 | text[1:]]
    ends = np.cumsum(size)
    ranks[ends - 1] = NONE
    while len(words):
        least = np.minimum.reduceat(ranks.astype(np.int64) << 32 | np.arange(len(ranks)), ends - size)
        go = least < np.int64(NONE) << 32
        keep = np.repeat(go, size)
        if not go.all():
            done.append((words[~go], parts[~keep], size[~go]))
        words, least = words[go], least[go]
        at, first, last = least & 0xFFFFFFFF, (ends - size)[go], ends[go] - 1
        parts[at] = least >> 32
        keep[at + 1] = False
        left, right = at[at > first] - 1, at[at + 1 < last]
        ranks[at] = NONE
        fresh = v.pair(parts[np.concatenate((left, right))], parts[np.concatenate((left + 1, right + 2))])
        ranks[left], ranks[right] = fresh[: len(left)], fresh[len(left) :]
        parts, ranks, size = parts[keep], ranks[keep], size[go] - 1
        ends = np.cumsum(size)
    return done


def merge_long(v: Vocabulary, word: np.ndarray) -> np.ndarray:
    """Encodes one long word: a heap of (rank, place) over linked parts."""
    parts = v.bytes[word].tolist()
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    first = v.pair(v.bytes[word][:-1], v.bytes[word][1:])
    heap = [(int(first[i]), i, parts[i], parts[i + 1]) for i in np.flatnonzero(first < NONE).tolist()]
    heapq.heapify(heap)
    pairs: dict[int, int] = {}

    def rank(a: int, b: int) -> int:
        key = a << 32 | b
        if key not in pairs:
            pairs[key] = int(v.pair(np.array([a]), np.array([b]))[0])
        return pairs[key]

    while heap:
        r, i, a, b = heapq.heappop(heap)
        if not alive[i] or parts[i] != a or after[i] >= n or parts[after[i]] != b:
            continue
        j = after[i]
        parts[i], alive[j], after[i] = r, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := rank(r, parts[after[i]])) < NONE:
                heapq.heappush(heap, (x, i, r, parts[after[i]]))
        if before[i] >= 0 and (x := rank(parts[before[i]], r)) < NONE:
            heapq.heappush(heap, (x, before[i], parts[before[i]], r))
    return np.array([p for p, ok in zip(parts, alive) if ok], np.int64)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, space or other, of every code point, as the pattern's engine sees it."""
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            if hi - lo == m.end() - m.start():
                out[lo:hi] = kind
            else:  # a run over the gap of the surrogates
                for c in m.group():
                    out[ord(c)] = kind
    return out


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pattern's matches, in all texts, and len+1 offsets of each text's."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _classes()[cp]
    text = np.searchsorted(lead, offs)  # in code points
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin[text[:-1][text[:-1] < n]] = True
    runs_ = np.flatnonzero(begin)
    ends = np.append(runs_[1:], n)
    k = kind[runs_]
    text_start = np.zeros(n + 1, bool)
    text_start[text] = True
    # a white-space run that is followed within its text gives its last character to a piece of its own, or to the next run
    space = np.flatnonzero((k == _SPACE) & ~text_start[ends])
    last = ends[space] - 1
    begin[last] = True
    joined = last[cp[last] == 32] + 1
    begin[joined] = False
    # contractions: an apostrophe that starts a piece, and is all of its run, takes letters of the next run
    quote = runs_[(k == _OTHER) & (ends - runs_ == 1) & (cp[runs_] == 39)]
    quote = quote[begin[quote]]
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~text_start[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(text_start[np.minimum(quote + 2, n)], 0, two)
        take = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        take = np.where((take == 0) & pair, 2, take)
        quote, take = quote[take > 0], take[take > 0]
        begin[quote + 1] = False
        rest = quote + 1 + take
        rest = rest[rest < n]
        begin[rest] = True
    at = np.flatnonzero(begin)
    return lead[at], np.searchsorted(at, text)


class Memo:
    """Tokens of words by their hash, for all chunks of one worker; it starts anew when it holds over `most` words.

    A table of open addressing, over arrays that are at most half full, gives the number of a word.
    """

    def __init__(self, most: int = MEMO):
        self.most, self.keys, self.parts, self.size = most, np.zeros(0, np.uint64), [np.zeros(0, np.int32)], 0
        self.start, self.count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self._table(12)

    def __len__(self) -> int:
        return len(self.keys)

    def _table(self, bits: int) -> None:
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)
        self._place(np.arange(len(self.keys)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).view(np.int64)

    def _place(self, rows: np.ndarray) -> None:
        slot = self._slot(self.keys[rows])
        while len(rows):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = rows[free]  # of several that want a slot, one gets it
            rest = self.slots[slot] != rows
            rows, slot = rows[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 of those that aren't there."""
        slot = self._slot(keys)
        out = self.slots[slot].astype(np.int64)
        if not len(self.keys):
            return out
        on = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.slots) - 1)
            out[on] = self.slots[slot[on]]
            on = on[(out[on] >= 0) & (self.keys[out[on]] != keys[on])]
        return out

    def add(self, keys: np.ndarray, tokens: np.ndarray, count: np.ndarray) -> None:
        """Words that aren't there yet, each once."""
        n, self.keys = len(self.keys), np.concatenate((self.keys, keys))
        if 2 * len(self.keys) > len(self.slots):
            self._table((2 * len(self.keys)).bit_length())
        else:
            self._place(np.arange(n, len(self.keys)))
        self.start.append(self.size + np.cumsum(count) - count)
        self.count.append(count)
        self.parts.append(tokens)
        self.size += len(tokens)

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens, and the start and number of each word's."""
        for x in (self.parts, self.start, self.count):
            if len(x) > 1:
                x[:] = [np.concatenate(x)]
        return self.parts[0], self.start[0], self.count[0]


def merge_words(v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words, one after the other, and how many each has."""
    rows = np.flatnonzero(size <= LONG)
    found = [(rows[r], p, n) for r, p, n in merge_short(v, data[ragged(start[rows], size[rows])], size[rows])] if len(rows) else []
    for r in np.flatnonzero(size > LONG).tolist():
        word = merge_long(v, data[start[r] : start[r] + size[r]])
        found.append((np.array([r]), word, np.array([len(word)])))
    count = np.zeros(len(start), np.int64)
    for rows, _, n in found:
        count[rows] = n
    begin = np.cumsum(count) - count
    tokens = np.empty(int(count.sum()), np.int32)
    for rows, p, n in found:
        tokens[ragged(begin[rows], n)] = p
    return tokens, count


def encode_pieces(v: Vocabulary, data: np.ndarray, offs: np.ndarray, memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all texts; the byte starts of the pieces, len+1 token offsets of these, and len+1 piece offsets of the texts."""
    start, at = pieces(data, offs)
    if not len(start):
        return np.zeros(0, np.int64), start, np.zeros(1, np.int64), at
    end = np.append(start[1:], len(data))
    words = pa.array(span_hashes(data, start, end)).dictionary_encode()
    keys, which = words.dictionary.to_numpy(), words.indices.to_numpy()
    memo = Memo() if memo is None else memo
    if len(memo) > memo.most:
        memo.__init__(memo.most)
    row = memo.find(keys)
    new = np.flatnonzero(row < 0)
    if len(new):
        row[new] = len(memo) + np.arange(len(new))
        one = np.empty(len(keys), np.int64)
        one[which] = np.arange(len(which))  # some place of each word
        memo.add(keys[new], *merge_words(v, data, start[one[new]], (end - start)[one[new]]))
    tokens, begin, count = memo.flat()
    row = row[which]
    return tokens[ragged(begin[row], count[row])], start, np.concatenate(([0], np.cumsum(count[row]))), at


def encode(v: Vocabulary, data: np.ndarray, offs: np.ndarray, memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts and len+1 offsets."""
    tokens, _, total, at = encode_pieces(v, data, offs, memo)
    return tokens, total[at]


def decode(v: Vocabulary, tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of token sequences, and len+1 offsets."""
    size = v.offsets[tokens + 1] - v.offsets[tokens]
    total = np.concatenate(([0], np.cumsum(size)))
    return v.text[ragged(v.offsets[tokens], size)], total[offs]


@lru_cache(maxsize=2)
def worker_memo(v: Vocabulary) -> Memo:
    """This process's memo of a vocabulary."""
    return Memo()


def _encode_rows(shared):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = shared.value
        data, offs = flat(b.column("text"))
        tokens, at = encode(v, data, offs, worker_memo(v))
        back, where = decode(v, tokens, at)
        same = np.diff(where) == np.diff(offs)
        if same.all():
            differ = np.concatenate(([0], np.cumsum(back != data)))
            same = differ[offs[1:]] == differ[offs[:-1]]
        else:
            same = np.array([bytes(back[where[i] : where[i + 1]]) == bytes(data[offs[i] : offs[i + 1]]) for i in range(len(same))], bool)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at).astype(np.int32)), lists, pa.array(same.astype(np.int32))], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return run


def _decode_rows(shared, names: list[str]):
    def run(batches):
        v = shared.value
        for b in batches:
            lists = b.column("tokens")
            n = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            ids = lists.flatten()
            valid = ids.is_valid().to_numpy(zero_copy_only=False) if ids.null_count else np.ones(len(ids), bool)
            ids = ids.fill_null(-1).to_numpy().astype(np.int64)
            good = valid & (ids >= 0) & (ids < len(v.offsets) - 1)
            left = np.concatenate(([0], np.cumsum(good)))
            data, offs = decode(v, ids[good], left[np.concatenate(([0], np.cumsum(n)))])
            raw = data.tobytes()
            text = pa.array([raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in range(b.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names)

    return run


def coder(df: DataFrame, ranks_path: str):
    """The vocabulary, broadcast; a rank file has some 10,000 to 200,000 lines."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))


@operator
def bpe_encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, tokens (array of int) and round_trip, 1 where decoding gives the text's bytes again, of every row."""
    texts = docs.select(long("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(texts, _encode_rows(coder(docs, ranks_path)), "doc_id long, n_tokens int, tokens array<int>, round_trip int", CHUNK)


@operator
def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with `decoded`, the text of its tokens; bytes that are no UTF-8 become U+FFFD."""
    (name,) = unused(encoded, "decoded")
    schema = encoded.withColumn(name, F.lit("")).schema
    return map_arrow(encoded, _decode_rows(coder(encoded, ranks_path), [*encoded.columns, name]), schema)
