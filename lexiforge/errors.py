"""Errors of the search engine; each carries a context for logs."""

from __future__ import annotations

from typing import Any


class SearchError(Exception):
    def __init__(self, message: str, **context: Any):
        super().__init__(message)
        self.context = context

    def to_dict(self) -> dict[str, Any]:
        return {"context": self.context, "error": type(self).__name__, "message": str(self)}


class EmptySearchTerm(SearchError):
    def __init__(self):
        super().__init__("nothing to search for; set allow_empty_search to list all rows")


class UnknownAlgorithm(SearchError):
    def __init__(self, name: str, known: list[str]):
        super().__init__(f"no algorithm {name!r}; there are {', '.join(sorted(known))}", algorithm=name)


class InvalidConfig(SearchError):
    pass


class NoSearchableColumns(SearchError):
    def __init__(self):
        super().__init__("name the columns to search in")


class NotSupported(SearchError):
    pass


class IndexConflict(SearchError):
    def __init__(self, corpus: str, version: int):
        super().__init__(f"version {version} of the index of {corpus!r} is already there", corpus=corpus, version=version)


class QuerySyntax(SearchError):
    """A boolean query that can't be read; reason is one of the class's constructors."""

    def __init__(self, reason: str, message: str, **context: Any):
        super().__init__(message, reason=reason, **context)
        self.reason = reason

    @classmethod
    def token_limit(cls, n: int, most: int) -> QuerySyntax:
        return cls("token_limit", f"{n} tokens reach the limit of {most}", tokens=n, limit=most)

    @classmethod
    def depth_limit(cls, n: int, most: int) -> QuerySyntax:
        return cls("depth_limit", f"groups are nested {n} deep; {most} is the limit", depth=n, limit=most)

    @classmethod
    def unbalanced(cls) -> QuerySyntax:
        return cls("unbalanced", "parentheses don't match")

    @classmethod
    def open_quote(cls) -> QuerySyntax:
        return cls("open_quote", "a quotation isn't closed")

    @classmethod
    def empty(cls) -> QuerySyntax:
        return cls("empty", "a term is missing")

    @classmethod
    def negated_group(cls) -> QuerySyntax:
        return cls("negated_group", "! stands before a group; negate single terms")
