"""Settings of the engine and of one search."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class HighlighterConfig:
    """Only the tags have an effect: the whole document is returned, so the lengths are never read."""

    open_tag: str = "<em>"
    close_tag: str = "</em>"
    context_before: int = 50
    context_after: int = 100
    max_snippet_len: int = 200


@dataclass(frozen=True)
class Limits:
    """Caps of an evaluation; None is no cap. Capped sets keep the smallest ids or terms, so results are repeatable."""

    candidates: int | None = None
    vocabulary: int | None = None
    expansions: int | None = 32


@dataclass(frozen=True)
class SearchOptions:
    fuzzy: bool = False
    max_edit_distance: int = 2
    use_pinyin: bool = False
    highlight: bool = False
    #: None returns every hit.
    limit: int | None = 20
    enable_cache: bool = True
    explain: bool = False
    #: True keeps three surprising rules of the query language: expansions of ``term~`` find documents but don't
    #: score, the ``pinyin:`` prefix stays in the text that is looked up, and initials give no candidates.
    strict_compat: bool = True

    @classmethod
    def interactive(cls, **changes) -> SearchOptions:
        """The preset for a search box: fuzzy, pinyin and highlighting on."""
        return replace(cls(fuzzy=True, use_pinyin=True, highlight=True), **changes)
