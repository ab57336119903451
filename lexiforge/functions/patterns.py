"""LIKE patterns of the matching algorithms, built once per term and pruned where one covers another.

Positions are code points. A pattern is a string in which % and _ are wildcards and \\ escapes.
"""

from __future__ import annotations

import re


def escape(s: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", s)


def _has(s: str) -> str:
    return f"%{escape(s)}%"


def _unique(patterns: list[str]) -> list[str]:
    return list(dict.fromkeys(patterns))


def _around(v: str, i: int, j: int, between: str) -> str:
    return f"%{escape(v[:i])}{between}{escape(v[j:])}%"


def fuzzy_patterns(term: str, pruned: bool = True) -> list[str]:
    """Contained, prefix, one letter left out, one replaced, neighbours swapped, doubled letters, ends, long words.

    Pruned: a pattern with a letter left out matches wherever the term, its prefix form, or that letter's replacement
    does, so these are left out where the term is not empty.
    """
    v = term.strip().lower()
    n = len(v)
    out = [_has(v), escape(v) + "%"]
    out += [_around(v, i, i + 1, "%") for i in range(n)]
    out += [_around(v, i, i + 1, "_") for i in range(n)]
    swapped = [_has(v[:i] + v[i + 1] + v[i] + v[i + 2 :]) for i in range(n - 1)]
    ends: list[str] = []
    if n > 4:
        ends += [_has(v[:i] + v[i + 1 :]) for i in range(n - 1) if v[i] == v[i + 1]]
    if n > 3:
        ends += [f"{escape(v[0])}%{escape(v[-2:])}", f"{escape(v[:2])}%{escape(v[-1:])}"]
    words = [w for w in v.split(" ") if w]
    if len(words) > 1:
        ends += [_has(w) for w in words if len(w) > 2]
    if pruned and n:
        out = out[2 : 2 + n]
    return _unique(out + swapped + ends)


def levenshtein_patterns(term: str, distance: int, pruned: bool = True) -> list[str]:
    """Single (and from distance 2 double) deletions, insertions, replacements, swaps; from 3 also loose ends."""
    v = term.strip().lower()
    n = len(v)
    out = [_has(v)]
    if distance >= 1:
        out += [_has(v[:i] + v[i + 1 :]) for i in range(n)]
        inserted = [_around(v, i, i, "_") for i in range(n + 1)]
        if pruned and n:
            # the whole term lies in every match of its outer insertions, and a shorter form in the term's matches
            out, inserted = out[1:], inserted[1:-1]
        out += inserted
        out += [_around(v, i, i + 1, "_") for i in range(n)]
    if distance >= 2:
        out += [_has(v[:i] + v[i + 1 : j] + v[j + 1 :]) for i in range(n) for j in range(i + 1, n) if n - 2 >= 2]
        out += [_has(v[:i] + v[i + 1] + v[i] + v[i + 2 :]) for i in range(n - 1)]
    if distance >= 3 and n > 3:
        out += [escape(v[:2]) + "%", "%" + escape(v[-2:]), f"{escape(v[0])}%{escape(v[-1:])}"]
    return _unique(out)


_SOUNDS = (("ph", "f"), ("f", "ph"), ("ck", "k"), ("k", "ck"), ("z", "s"), ("s", "z"), ("wr", "r"), ("kn", "n"), ("gh", ""))


def soundex_patterns(term: str) -> list[str]:
    """The term, its beginning, its consonants, and spellings of like sound."""
    v = term.strip().lower()
    out = [_has(v)]
    if len(v) >= 4:
        out.append(escape(v[:3]) + "%")
    if len(v) > 2:
        bare = v[0] + re.sub("[aeiou]", "", v[1:])
        if len(bare) >= 2 and bare != v:
            out.append(_has(bare))
    out += [_has(v.replace(a, b)) for a, b in _SOUNDS if a in v and v.replace(a, b) != v]
    return _unique(out)


def trigrams(term: str) -> list[str]:
    s = f"  {term.strip().lower()} "
    return _unique([s[i : i + 3].strip() for i in range(len(s) - 2)])


def trigram_patterns(term: str, most: int = 10) -> list[str]:
    t = trigrams(term)
    return _unique([_has("".join(t)), *map(_has, t)])[:most]


def analysed(term: str) -> dict[str, list[str]]:
    """The forms of a term, for explanations."""
    v = term.lower()
    return {
        "contains": [_has(v)],
        "omissions": [_has(v[:i] + v[i + 1 :]) for i in range(len(v))],
        "prefix": [escape(v) + "%"],
        "suffix": ["%" + escape(v)],
        "transpositions": [_has(v[:i] + v[i + 1] + v[i] + v[i + 2 :]) for i in range(len(v) - 1)],
    }


def covers(wide: str, narrow: str) -> bool:
    """Whether every match of the pattern `narrow` is sure to match `wide`, for plain %text% patterns."""
    plain = re.compile(r"%((?:[^\\%_]|\\.)*)%", re.S)
    w, n = plain.fullmatch(wide), plain.fullmatch(narrow)
    return bool(w and n and w[1] in n[1])


def without_covered(patterns: list[str]) -> list[str]:
    """Drops each %text% pattern whose matches another one has as well."""
    return [p for i, p in enumerate(patterns) if not any(j != i and covers(q, p) and (q != p or j < i) for j, q in enumerate(patterns))]
