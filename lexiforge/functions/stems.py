"""Stems of German, Swedish, Danish and Norwegian words, by the public Snowball algorithms; English is in phonetic.py.

Each takes a word in lower case. They are applied to distinct words only (see counting.py).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from lexiforge.functions.phonetic import porter2


def _region(w: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _ending(w: str, least: int, endings: Sequence[str]) -> str:
    """The longest of the endings that w has at or behind place `least`; '' if none."""
    return max((e for e in endings if w.endswith(e) and len(w) - len(e) >= least), key=len, default="")


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    r1 = max(r1, 3)
    e = _ending(w, r1, ("em", "ern", "er", "e", "en", "es", "s"))
    if e and (e != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _ending(w, r1, ("en", "er", "est", "st"))
    if e and (e != "st" or len(w) > 5 and w[-3] in "bdfghklmnt"):
        w = w[: -len(e)]
    e = _ending(w, 0, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if e and len(w) - len(e) >= r2:
        stem = w[: -len(e)]
        if e in ("end", "ung"):
            w = stem
            if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif e in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            more = _ending(w, r2, ("lich", "ig"))
            w = w[: len(w) - len(more)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _without(w: str, r1: int, endings: Sequence[str], s_after: str, k: bool = False, vowels: str = "") -> str:
    """w without the longest ending; an s goes after certain letters, and after a k (if k) that no vowel precedes."""
    e = _ending(w, r1, (*endings, "s"))
    if e == "s":
        before = w[-2:-1]
        ok = before in tuple(s_after) or k and before == "k" and w[-3:-2] not in tuple(vowels)
        return w[:-1] if ok else w
    return w[: len(w) - len(e)]


_SWEDISH = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()


def swedish(w: str) -> str:
    r1 = max(3, _region(w, "aeiouyäåö"))
    w = _without(w, r1, _SWEDISH, "bcdfghjklmnoprtvy")
    if _ending(w, r1, ("dd", "gd", "nn", "dt", "gt", "kt", "tt")):
        w = w[:-1]
    e = _ending(w, r1, ("lig", "ig", "els", "löst", "fullt"))
    return w[:-1] if e in ("löst", "fullt") else w[: len(w) - len(e)]


_DANISH = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()


def danish(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(3, _region(w, vowels))
    pair = lambda w: w[:-1] if _ending(w, r1, ("gd", "dt", "gt", "kt")) else w
    w = pair(_without(w, r1, _DANISH, "abcdfghjklmnoprtvyzå"))
    if w.endswith("igst"):
        w = w[:-2]
    e = _ending(w, r1, ("ig", "lig", "elig", "els", "løst"))
    w = w[:-1] if e == "løst" else pair(w[: len(w) - len(e)]) if e else w
    return w[:-1] if len(w) > r1 and w[-1] not in vowels and w[-2:-1] == w[-1] and len(w) - 2 >= r1 - 1 else w


_NORWEGIAN = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()


def norwegian(w: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(3, _region(w, vowels))
    e = _ending(w, r1, (*_NORWEGIAN, "erte", "ert", "s"))
    w = w[: len(w) - len(e)] + "er" if e in ("erte", "ert") else _without(w, r1, _NORWEGIAN, "bcdfghjlmnoprtvyz", True, vowels)
    if _ending(w, r1, ("dt", "vt")):
        w = w[:-1]
    e = _ending(w, r1, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"))
    return w[: len(w) - len(e)]


STEMMERS: dict[str, Callable[[str], str]] = {"danish": danish, "english": porter2, "german": german, "norwegian": norwegian, "swedish": swedish}
