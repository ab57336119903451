"""Settings and their defaults. A Settings object is immutable; `with_` makes a changed copy."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

#: Short lists for indexing and presets, and what the long lists add for interactive searches.
_SHORT = {
    "en": "a an and at but for in is it of on or the to",
    "de": "aber an auf das der die für in oder und von zu",
    "fr": "dans des et la le les mais ou sur un une à",
    "es": "a el en la las los o pero sobre un una y",
}
_MORE = {
    "en": "as be been from has have he her him his my our she that their they this was we will with your",
    "de": "als aus dass dein dies du er es haben ich ihr ist mein mit sein sie unser war wir wird",
    "fr": "avec avoir ce ceci comme de elle est il ils je mon notre nous pour que sera son ton tu était être",
    "es": "como con de ella ellos era es esto mi nosotros nuestro para que ser será su tener tu tú yo él",
}
INDEX_STOP_WORDS: dict[str, tuple[str, ...]] = {k: tuple(v.split()) for k, v in _SHORT.items()}
SEARCH_STOP_WORDS: dict[str, tuple[str, ...]] = {k: tuple(sorted({*v.split(), *_MORE[k].split()})) for k, v in _SHORT.items()}

PRESETS: dict[str, dict[str, Any]] = {
    "blog": {"accent_insensitive": True, "algorithm": "fuzzy", "columns": {"title": 10, "body": 5, "excerpt": 3}, "stop_words": True, "typo_tolerance": 2},
    "ecommerce": {"algorithm": "fuzzy", "columns": {"name": 10, "description": 5, "sku": 8, "brand": 6}, "partial_match": True, "typo_tolerance": 1},
    "exact": {"algorithm": "simple", "partial_match": True, "typo_tolerance": 0},
    "phonetic": {"algorithm": "soundex", "columns": {"name": 10}, "typo_tolerance": 0},
    "users": {"accent_insensitive": True, "algorithm": "levenshtein", "columns": {"name": 10, "email": 8, "username": 9}, "typo_tolerance": 2},
}

#: Weights of columns that are searched where none are named, by name.
LIKELY_COLUMNS = {**dict.fromkeys(("name", "title"), 10), **dict.fromkeys(("email", "username"), 8), **dict.fromkeys(("first_name", "last_name"), 7), **dict.fromkeys(("description", "content", "body"), 5), **dict.fromkeys(("bio", "summary", "excerpt"), 3), "slug": 2, "sku": 6, "code": 6}
SYSTEM_COLUMNS = frozenset(["created_at", "deleted_at", "id", "password", "remember_token", "updated_at"])


@dataclass(frozen=True)
class Settings:
    algorithm: str = "fuzzy"
    max_candidates: int = 1000
    allow_empty_search: bool = False
    unknown_algorithm_is_levenshtein: bool = False
    use_native: bool = False
    min_search_length: int = 2
    max_term_length: int = 128
    max_query_tokens: int = 32
    max_query_depth: int = 16
    max_distance: int = 2
    trigram_min_similarity: float = 30
    accent_insensitive: bool = True
    locale: str = "en"
    k1: float = 1.5
    b: float = 0.75
    max_postings: int | None = None
    global_df: bool = False
    max_tokens_per_doc: int = 5000
    memory_max_items: int = 10_000
    memory_min_similarity: int = 60
    max_per_page: int = 100
    spelling_candidates: int = 300
    merge_segments: int = 8  # changes of an index that wait before they are merged into it
    keep_versions: int = 10  # versions of an index that readers may still have open
    broadcast_rows: int = 500_000  # most rows of a side that is broadcast
    presets: dict[str, dict[str, Any]] = field(default_factory=lambda: dict(PRESETS))

    def with_(self, **changes: Any) -> Settings:
        return replace(self, **changes)


DEFAULT = Settings()
