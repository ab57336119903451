"""The boolean query language: words, "phrases", =exact ^prefix suffix$ 'included, !not, | for or, and groups.

    query := all ("|" all)* ; all := part part* ; part := "(" query ")" | term

A query becomes a tree of nodes, and the tree a Column: a term matches if one of the columns does; a negated term
excludes rows whose columns are null, as three-valued logic has it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.config import DEFAULT, Settings
from lexiforge.errors import QuerySyntax
from lexiforge.functions import expressions as X


@dataclass(frozen=True)
class Token:
    kind: str  # ( ) | or one of the term kinds
    value: str = ""
    negated: bool = False


@dataclass(frozen=True)
class Term:
    kind: str  # has, exact, prefix, suffix, include
    value: str

    def depth(self) -> int:
        return 1


@dataclass(frozen=True)
class Not:
    child: Node

    def depth(self) -> int:
        return 1 + self.child.depth()


@dataclass(frozen=True)
class All:
    children: tuple[Node, ...]

    def depth(self) -> int:
        return 1 + max(c.depth() for c in self.children)


@dataclass(frozen=True)
class Any_:
    children: tuple[Node, ...]

    def depth(self) -> int:
        return 1 + max(c.depth() for c in self.children)


Node = Term | Not | All | Any_
_MARKS = {"'": "include", "=": "exact", "^": "prefix"}
_BLANK = " \t\n\r\v\f"


def tokens(query: str, most: int = DEFAULT.max_query_tokens) -> list[Token]:
    """Tokens of a query; reaching `most` is an error. A mark without a term is passed over."""
    q = query.strip(_BLANK + "\0")
    found: list[Token] = []
    at = 0
    while at < len(q):
        c = q[at]
        if c in _BLANK:
            at += 1
            continue
        if c in "|()":
            found.append(Token(c))
            at += 1
        elif c == '"':
            end = q.find('"', at + 1)
            if end < 0:
                raise QuerySyntax.open_quote()
            found.append(Token("has", q[at + 1 : end]))
            at = end + 1
        else:
            negated = c == "!"
            if negated:
                at += 1
                if at == len(q):
                    break
                if q[at] == "(":
                    raise QuerySyntax.negated_group()
            kind = _MARKS.get(q[at], "")
            at += bool(kind)
            end = at
            while end < len(q) and q[end] not in _BLANK + "|()!":
                end += 1
            word, at = q[at:end], end
            if not kind and word.endswith("$"):
                kind, word = "suffix", word[:-1]
            if not word:
                continue
            found.append(Token(kind or "has", word, negated))
        if len(found) >= most:
            raise QuerySyntax.token_limit(len(found), most)
    return found


def parse(found: Sequence[Token], deepest: int = DEFAULT.max_query_depth) -> Node:
    """The tree of a token sequence."""
    at = 0

    def kind() -> str | None:
        return found[at].kind if at < len(found) else None

    def any_of(level: int) -> Node:
        nonlocal at
        parts = [all_of(level)]
        while kind() == "|":
            at += 1
            parts.append(all_of(level))
        return parts[0] if len(parts) == 1 else Any_(tuple(parts))

    def all_of(level: int) -> Node:
        parts = [one(level)]
        while kind() not in (None, "|", ")"):
            parts.append(one(level))
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def one(level: int) -> Node:
        nonlocal at
        k = kind()
        if k in (None, "|", ")"):
            raise QuerySyntax.empty()
        token = found[at]
        at += 1
        if k != "(":
            term = Term(token.kind, token.value)
            return Not(term) if token.negated else term
        if level + 1 > deepest:
            raise QuerySyntax.depth_limit(level + 1, deepest)
        inner = any_of(level + 1)
        if kind() != ")":
            raise QuerySyntax.unbalanced()
        at += 1
        return inner

    if not found:
        raise QuerySyntax.empty()
    tree = any_of(0)
    if at < len(found):
        raise QuerySyntax.unbalanced()
    return tree


def predicate(node: Node, columns: Sequence[str]) -> Column:
    """The tree as a Boolean Column over the columns."""
    if isinstance(node, Not):
        return ~predicate(node.child, columns)
    if isinstance(node, All):
        return reduce(and_, [predicate(c, columns) for c in node.children])
    if isinstance(node, Any_):
        return reduce(or_, [predicate(c, columns) for c in node.children])
    v = node.value.lower()
    test = {"exact": lambda c: c == F.lit(v), "prefix": lambda c: c.startswith(v), "suffix": lambda c: c.endswith(v)}.get(node.kind, lambda c: c.contains(v))
    return reduce(or_, [test(F.lower(X.text(c))) for c in columns])


def positive_terms(node: Node) -> list[str]:
    """The values of the terms that aren't negated."""
    if isinstance(node, Term):
        return [node.value]
    return [] if isinstance(node, Not) else [t for c in node.children for t in positive_terms(c)]


def compiled(query: str, columns: Sequence[str], settings: Settings = DEFAULT) -> Column:
    return predicate(parse(tokens(query, settings.max_query_tokens), settings.max_query_depth), columns)
