"""Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.terms import ACCENTS

ESC = "\\"


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _plain(s: str) -> str | None:
    """A pattern part without wildcards, unescaped; None if it has any."""
    if re.search(r"(?<!\\)(?:\\\\)*[%_]", s):
        return None
    return re.sub(r"\\(.)", r"\1", s)


def like(c: Column, pattern: str) -> Column:
    """A case-insensitive LIKE; c is in lower case. Simple forms become contains, startswith, endswith or equality."""
    p = pattern.lower()
    body = p[1:-1] if len(p) > 1 and p[0] == p[-1] == "%" and not p.endswith("\\%") else None
    if body is not None and (s := _plain(body)) is not None:
        return c.contains(s)
    if p.endswith("%") and not p.endswith("\\%") and (s := _plain(p[:-1])) is not None:
        return c.startswith(s)
    if p.startswith("%") and (s := _plain(p[1:])) is not None:
        return c.endswith(s)
    if (s := _plain(p)) is not None:
        return c == s
    return c.like(p)


def like_any(c: Column, patterns: Sequence[str]) -> Column:
    low = F.lower(c)
    return reduce(or_, [like(low, p) for p in patterns])


def fold(c: Column) -> Column:
    """Lower case without accents, as an expression."""
    one = {k: v for k, v in ACCENTS.items() if len(v) == 1}
    return F.lower(F.replace(F.translate(c, "".join(one), "".join(one.values())), F.lit("ß"), F.lit("ss")))


def trigram_set(c: Column) -> Column:
    """The distinct trigrams of a text's words, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column | str) -> Column:
    """Shared trigrams over all trigrams of both; 0 if neither has any."""
    x, y = trigram_set(a), trigram_set(F.lit(b) if isinstance(b, str) else b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def levenshtein(a: Column, b: Column | str, *, in_bytes: bool = False) -> Column:
    """Edit distance of lower-case forms, over code points or over UTF-8 bytes."""
    a, b = F.lower(a), F.lower(F.lit(b) if isinstance(b, str) else b)
    if in_bytes:
        a, b = (F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b))
    return F.levenshtein(a, b)


def within(a: Column, b: str, most: int) -> Column:
    """Edit distance of at most `most`, given up early beyond it."""
    return F.levenshtein(a, F.lit(b), most).between(0, most)


def position(c: Column, needle: str) -> Column:
    """1-based place of needle, 0 where absent."""
    return F.instr(c, needle)


def first_word(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def last_word(c: Column) -> Column:
    return F.substring_index(c, " ", -1)


def html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def match_offsets(c: Column, needle: str, *, in_bytes: bool = False) -> Column:
    """[[first, last], ...] of needle in c, without overlap, ignoring case; 0-based and inclusive."""
    size = (lambda x: F.octet_length(x)) if in_bytes else (lambda x: F.length(x))
    n = F.lit(len(needle.encode()) if in_bytes else len(needle))
    parts = F.split(F.lower(c), re.escape(needle.lower()), -1)
    heads = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    grown = F.aggregate(heads, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), lambda acc, p: F.struct(
        (acc["at"] + size(p) + n).alias("at"),
        F.concat(acc["out"], F.array(F.array(acc["at"] + size(p), acc["at"] + size(p) + n - 1))).alias("out"),
    ))
    return F.when(c.isNull() | F.lit(needle == ""), F.array().cast("array<array<int>>")).otherwise(grown["out"])


def wrapped(c: Column, offsets: Column, before: str, after: str) -> Column:
    """c with HTML escaped and each range of code points between tags."""
    done = F.aggregate(offsets, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, o: F.struct(
        (o[1] + 1).alias("at"),
        F.concat(acc["out"], html(F.substring(c, acc["at"] + 1, o[0] - acc["at"])), F.lit(before), html(F.substring(c, o[0] + 1, o[1] - o[0] + 1)), F.lit(after)).alias("out"),
    ))
    return F.concat(done["out"], html(F.substring(c, done["at"] + 1, F.length(c))))
