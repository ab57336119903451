"""What has no built-in counterpart: similarity by common substrings, Metaphone, English stems, weighted edit distance.

Each has an Arrow-batched UDF. Metaphone and the weighted distance treat a whole batch at once in numpy, so that they can
be applied to tables; similarity and stems are for few values: candidates after a top-k, or the distinct vocabulary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the longer text from which common substrings are searched row by row in numpy.
LONG = 64


def _longest(a: bytes, b: bytes) -> tuple[int, int, int]:
    """Length and places of the longest common substring, the first in a and then in b."""
    best, bi, bj = 0, 0, 0
    if len(b) >= LONG:
        y, run = np.frombuffer(b, np.uint8), np.zeros(len(b) + 1, np.int32)
        for i in range(len(a) - 1, -1, -1):
            # run[j]: common run that starts at (i, j); rows from the end, so that the earliest start wins
            run[:-1] = np.where(y == a[i], run[1:] + 1, 0)
            j = int(run.argmax())
            if run[j] >= max(1, best):
                best, bi, bj = int(run[j]), i, j
        return best, bi, bj
    row = [0] * (len(b) + 1)
    for i in range(len(a) - 1, -1, -1):
        new = [0] * (len(b) + 1)
        x = a[i]
        for j in range(len(b) - 1, -1, -1):
            if b[j] == x:
                new[j] = row[j + 1] + 1
                if new[j] >= best:
                    best, bi, bj = new[j], i, j
        row = new
    return best, bi, bj


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common substring and, again, of those to its left and right."""
    todo, total = [(a, b)], 0
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        n, i, j = _longest(x, y)
        if n:
            total += n
            todo += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


def similar_text(a: str, b: str) -> float:
    """Percentage of bytes in common substrings: 200 * common / (len(a) + len(b)); 0 for two empty strings."""
    x, y = a.encode(), b.encode()
    return 200.0 * _common(x, y) / (len(x) + len(y)) if x or y else 0.0


def _flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and len+1 offsets; null counts as empty."""
    arr = pa.array([], pa.string()) if not len(arr) else arr.cast(pa.string()).fill_null("")
    offs = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int32)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    return data[offs[0] : offs[-1]], (offs - offs[0]).astype(np.int64)


#: No letter, so many times, between two words: rules look so far.
_GAP = 5


def metaphones(words: pa.Array) -> pa.Array:
    """Metaphone codes of whole strings, all at once; what is no letter is passed over; null stays null."""
    data, offs = _flat(pc.utf8_upper(pc.replace_substring(words.cast(pa.string()), "ß", "ss")))
    keep = (data >= 65) & (data <= 90)
    left = np.concatenate(([0], np.cumsum(keep)))[offs]
    n, count = len(words), np.diff(left)
    row = np.repeat(np.arange(n), count)
    place = np.arange(len(row)) + _GAP * (row + 1)
    w = np.zeros(len(row) + _GAP * (n + 1), np.uint8)
    w[place] = data[keep]
    at = lambda k: w[place + k]
    isin = lambda k, letters: np.isin(at(k), np.frombuffer(letters.encode(), np.uint8))
    c, before, nx, nx2, nx3 = at(0), at(-1), at(1), at(2), at(3)
    is_ = lambda x, letter: x == ord(letter)
    i = np.arange(len(row)) - left[:-1][row]  # place in the word
    one, skip = np.zeros(len(row), np.uint8), np.zeros(len(row), np.int8)

    def rule(when: np.ndarray, code: str = "", skips: int = 0) -> np.ndarray:
        """Sets the code of letters that no rule before has taken."""
        new = when & ~taken
        one[new] = ord(code) if code else 0
        skip[new] = skips
        taken[new] = True
        return new

    # how a word begins
    two = c.astype(np.int32) << 8 | nx
    pair = lambda *x: np.isin(two, [ord(p[0]) << 8 | ord(p[1]) for p in x])
    begins = i == 0
    start = np.zeros(n, np.int64)
    for when, first in ((begins & pair("AE", "WH"), 2), (begins & pair("GN", "KN", "PN", "WR"), 1), (begins & is_(c, "X"), 1)):
        start[row[when]] = first
    begin = start[row]
    taken = i < begin
    one[taken & begins & pair("AE")] = ord("E")
    one[taken & begins & pair("WH")] = ord("W")
    one[taken & begins & is_(c, "X")] = ord("S")

    vowel, front, h = "AEIOU", isin(1, "EIY"), is_(nx, "H")
    rule((c == before) & ~is_(c, "C") & (i > begin))
    first = isin(0, vowel) & (i == begin) & (begin == 0)
    one[first & ~taken] = c[first & ~taken]
    taken |= isin(0, vowel)
    rule(is_(c, "B") & is_(before, "M") & (nx == 0))
    k = is_(c, "C")
    rule(k & front & is_(nx, "I") & is_(nx2, "A"), "X")
    rule(k & front & ~is_(before, "S"), "S")
    rule(k & front)
    rule(k & h & (is_(nx2, "R") | is_(before, "S")), "K", 1)
    rule(k & h, "X", 1)
    rule(k, "K")
    rule(is_(c, "D") & is_(nx, "G") & isin(2, "EIY"), "J", 1)
    rule(is_(c, "D"), "T")
    k = is_(c, "G")
    rule(k & h & (isin(-3, "BDH") | is_(at(-4), "H")))
    rule(k & h, "F", 1)
    rule(k & is_(nx, "N") & ((nx2 == 0) | is_(nx2, "E") & is_(nx3, "D") & (at(4) == 0)))
    rule(k & is_(nx, "N"), "K")
    rule(k & front & ~is_(before, "G"), "J")
    rule(k, "K")
    rule(is_(c, "H") & isin(1, vowel) & ~isin(-1, "CGPST"), "H")
    rule(is_(c, "H"))
    rule(is_(c, "K") & is_(before, "C"))
    rule(is_(c, "P") & h, "F", 1)
    rule(is_(c, "Q"), "K")
    k = is_(c, "S")
    rule(k & is_(nx, "I") & isin(2, "OA"), "X")
    rule(k & h, "X", 1)
    rule(k & is_(nx, "C") & is_(nx2, "H") & is_(nx3, "W"), "X", 2)
    k = is_(c, "T")
    rule(k & is_(nx, "I") & isin(2, "OA"), "X")
    rule(k & h, "0", 1)
    rule(k & is_(nx, "C") & is_(nx2, "H"))
    rule(is_(c, "V"), "F")
    rule(isin(0, "WY") & ~isin(1, vowel))
    x = rule(is_(c, "X"), "K")
    rule(is_(c, "Z"), "S")
    one = np.where(taken, one, c)

    # a letter that the one before has taken with it says nothing; it begins no rule that skips but those within that reach
    gone = np.zeros(len(row), bool)
    for by in (1, 2):
        hit = np.flatnonzero(skip >= by) + by
        gone[hit] = True
    size = np.where((one > 0) & ~gone, 1 + x.astype(np.int64), 0)
    total = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(total[-1], np.uint8)
    out[total[:-1][size > 0]] = one[size > 0]
    out[total[:-1][size == 2] + 1] = ord("S")
    text = pa.StringArray.from_buffers(n, pa.py_buffer(total[left].astype(np.int32)), pa.py_buffer(out))
    return pc.if_else(words.is_valid(), text, pa.scalar(None, pa.string())) if words.null_count else text


def metaphone(word: str) -> str:
    return metaphones(pa.array([word], pa.string()))[0].as_py()


#: Cells of the matrix of one step of weighted distances.
_CELLS = 1 << 22


def weighted_distances(a: pa.Array, b: pa.Array, insert: int = 1, replace: int = 1, delete: int = 1) -> pa.Array:
    """Edit distances of lower-case UTF-8 bytes with costs for turning a into b; null where one is null.

    All pairs go through one row of their matrices at a time; pairs of about one length share a step.
    """
    x, y = _flat(pc.utf8_lower(a.cast(pa.string()))), _flat(pc.utf8_lower(b.cast(pa.string())))
    n, m = np.diff(x[1]), np.diff(y[1])
    out, order, lo = np.zeros(len(n), np.int64), np.lexsort((n, m)), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (m[order[hi]] + 1) <= _CELLS and hi - lo < 4096:
            hi += 1
        rows = order[lo:hi]
        wide, tall, each = int(m[rows].max()), int(n[rows].max()), np.arange(hi - lo)
        cols = np.arange(wide)
        right = np.where(cols < m[rows][:, None], y[0][np.minimum(y[1][:-1][rows][:, None] + cols, max(0, len(y[0]) - 1))], 0) if len(y[0]) else np.zeros((hi - lo, wide), np.uint8)
        steps = np.arange(wide + 1) * insert
        row = np.tile(steps, (hi - lo, 1))
        best = row[each, m[rows]]
        for i in range(tall):
            c = x[0][np.minimum(x[1][:-1][rows] + i, len(x[0]) - 1)]
            new = np.empty_like(row)
            new[:, 0] = (i + 1) * delete
            new[:, 1:] = np.minimum(row[:, :-1] + (right != c[:, None]) * replace, row[:, 1:] + delete)
            # insertions run from left to right: the least so far, with their cost taken off
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            best = np.where(n[rows] == i + 1, row[each, m[rows]], best)
        out[rows] = best
        lo = hi
    some = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(out.astype(np.int32), mask=~some)


def weighted_distance(a: str, b: str, insert: int = 1, replace: int = 1, delete: int = 1) -> int:
    return weighted_distances(pa.array([a]), pa.array([b]), insert, replace, delete)[0].as_py()


# -- English stems, Porter's second algorithm


def _vowel_at(w: str, i: int) -> bool:
    return w[i] in "aeiouy"


def _region(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if not _vowel_at(w, i) and _vowel_at(w, i - 1):
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return _vowel_at(w, 0) and not _vowel_at(w, 1)
    return len(w) > 2 and not _vowel_at(w, -3) and _vowel_at(w, -2) and not _vowel_at(w, -1) and w[-1] not in "wxY"


_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {x: x for x in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

#: What the endings of all rules end in; other words are their own stems.
_ENDS = "'cdegilmnrsty"


def porter2(word: str) -> str:
    """The stem of an English word in lower case."""
    if len(word) < 3:
        return word
    w = word.lower().lstrip("'")
    if w in _WHOLE:
        return _WHOLE[w]
    if w[-1:] not in _ENDS:
        return w
    if "y" in w:
        w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiouy") else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(_vowel_at(w, i) for i in range(len(w) - 2)):
        w = w[:-1]
    if w in _KEPT:
        return w
    # past tenses and adverbs
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(_vowel_at(w, i) for i in range(len(w) - len(s))):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and not _vowel_at(w, -2):
        w = w[:-1] + "i"
    for s, t in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + t
            break
    for s, t in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + t
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.DoubleType())
def similar_text_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similar_text(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def metaphone_udf(c: pd.Series) -> pd.Series:
    return pd.Series(metaphones(pa.array(c.tolist(), pa.string())).to_pylist(), dtype=object)


@F.pandas_udf(T.StringType())
def porter2_udf(c: pd.Series) -> pd.Series:
    return c.map(porter2, na_action="ignore")


def weighted_distance_udf(insert: int, replace: int, delete: int):
    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(weighted_distances(pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), insert, replace, delete).to_pylist(), dtype="Int32")

    return distance


def register_sql(spark) -> None:
    """Makes similar_text(a, b), metaphone(s) and porter2(s) available to SQL."""
    spark.udf.register("similar_text", similar_text_udf)
    spark.udf.register("metaphone", metaphone_udf)
    spark.udf.register("porter2", porter2_udf)
