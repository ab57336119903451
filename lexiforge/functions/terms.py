"""Search terms, on the driver: they are short strings, so plain Python prepares them once per query."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence

#: Letters of Latin-1 that lose their mark. Æ, Þ and others of no single base letter stay.
_PLAIN = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ý"}
ACCENTS = {x: k for k, v in _PLAIN.items() for x in v} | {x.upper(): k.upper() for k, v in _PLAIN.items() for x in v} | {"ÿ": "y", "ß": "ss"}


def remove_accents(s: str) -> str:
    return s.translate(str.maketrans(ACCENTS))


def remove_words(s: str, stop: Iterable[str]) -> str:
    stop = set(stop)
    return " ".join(w for w in re.split(r"\s+", s) if w.lower() not in stop)


def prepare(term: str, *, nfc: bool = False, accents: bool = False, stop: Sequence[str] = ()) -> str:
    """NFC, accents, stop words, in this order, then trimmed."""
    if nfc:
        term = unicodedata.normalize("NFC", term)
    if accents:
        term = remove_accents(term)
    if stop:
        term = remove_words(term, stop)
    return term.strip()


def with_synonyms(term: str, synonyms: Mapping[str, Sequence[str]], groups: Sequence[Sequence[str]]) -> list[str]:
    low = term.lower()
    found = [term, *synonyms.get(low, ())]
    for g in groups:
        if low in g:
            found += g
    return list(dict.fromkeys(found))
