"""The query language: a text becomes a tree of operators, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Escaped, for pasted characters would be changed by normalisation.
_CJK = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U0002f800-\U0002fa1f"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[A-Za-z][A-Za-z0-9_-]*|[0-9]+|[{_CJK}]+|[^{_SPACE}]")
_CHINESE = re.compile(f"[{_CJK}]")
_GAP = re.compile(f"[{_SPACE}]")
_BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Largest edit distance of ``term~N``.
MOST_EDITS = 3


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Fuzzy:
    term: str
    distance: int


@dataclass(frozen=True)
class Prefix:
    prefix: str


@dataclass(frozen=True)
class CharMatch:
    chars: tuple[str, ...]


@dataclass(frozen=True)
class And:
    children: tuple = ()


@dataclass(frozen=True)
class Or:
    children: tuple = ()


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class ParsedQuery:
    root: object
    original: str
    use_pinyin: bool
    max_edit_distance: int


def has_chinese(text: str) -> bool:
    return bool(_CHINESE.search(text))


def query_terms(text: str) -> list[str]:
    """The tokenizer of ``functions.tokenize`` for one text on the driver."""
    out: list[str] = []
    for piece in _PIECE.findall(text):
        if piece[0].isascii() and piece[0].isalpha():
            out.append(piece.lower())
        elif _CHINESE.match(piece):
            n = len(piece)
            for o in range(n):
                out += [piece[o : o + k] for k in range(1, min(4, n - o) + 1)]
                if o == 0 and n > 4:
                    out.append(piece)
        else:
            out.append(piece)
    return out


def split_operator(text: str, operator: str) -> list[str]:
    """Parts between occurrences of a word in any case, outside of quotes; empty parts are dropped."""
    marks = re.finditer(f'"|(?<![^{_SPACE}]){operator}(?![^{_SPACE}])', text, re.IGNORECASE | re.ASCII)
    quotes, edges = 0, [0]
    for mark in marks:
        if mark[0] == '"':
            quotes += 1
        elif quotes % 2 == 0:
            edges.extend(mark.span())
    edges.append(len(text))
    between = (text[a:b].strip(_BLANKS) for a, b in zip(edges[::2], edges[1::2], strict=True))
    return [part for part in between if part] or [text]


class QueryParser:
    """Terms, ``"a phrase"`` at the start of a query, AND, OR, ``-excluded``, ``term~2``, ``prefix*``, ``pinyin:``."""

    def __init__(self, default_distance: int = 2):
        self.default_distance = default_distance

    def parse(self, text: str) -> ParsedQuery:
        body = text.strip(_BLANKS)
        pinyin = body.startswith(("pinyin:", "py:"))
        if pinyin:
            body = body.split(":", 1)[1].strip(_BLANKS)
        return ParsedQuery(self._expression(body) if body else And(), text, pinyin, self.default_distance)

    def _expression(self, text: str):
        if (phrase := self._phrase(text)) is not None:
            return phrase
        parts = split_operator(text, "OR")
        if len(parts) > 1:
            ops = [op for op in map(self._and, parts) if op != And()]
            return ops[0] if len(ops) == 1 else Or(tuple(ops))
        return self._and(text)

    def _phrase(self, text: str):
        body = text.strip(_BLANKS)
        end = body.find('"', 1) if body.startswith('"') else -1
        terms = query_terms(body[1:end]) if end > 0 else []
        return Phrase(tuple(terms)) if terms else None

    def _and(self, text: str):
        keep, out = [], []
        for part in split_operator(text, "AND"):
            part = part.strip(_BLANKS)
            if not part:
                continue
            if part.startswith("-"):
                out.append(self._term(part[1:]))
            elif (at := part.find(" -")) >= 0:
                a, b = part[:at].strip(_BLANKS), part[at + 2 :].strip(_BLANKS)
                keep += [self._term(a)] if a else []
                out += [self._term(b)] if b else []
            else:
                keep.append(self._term(part))
        ops = keep + [Not(x) for x in out]
        return ops[0] if len(ops) == 1 else And(tuple(ops))

    def _term(self, text: str):
        text = text.strip(_BLANKS)
        if not text:
            return And()
        head, tilde, tail = text.rpartition("~")
        if tilde and head:
            digits = tail[1:] if tail.startswith("+") else tail
            distance = int(digits) if digits.isascii() and digits.isdigit() else self.default_distance
            return self._each(query_terms(head), lambda t: Fuzzy(t, min(distance, MOST_EDITS)))
        if text.endswith("*") and len(text) > 1:
            return self._each(query_terms(text[:-1]), Prefix)
        terms = query_terms(text)
        if has_chinese(text) and len(terms) >= 2:
            chars = tuple(c for c in text if not _GAP.match(c))
            if len(chars) >= 2:
                return Or((And(tuple(map(Term, terms))), CharMatch(chars)))
        return self._each(terms, Term)

    @staticmethod
    def _each(terms: list[str], make):
        return make(terms[0]) if len(terms) == 1 else And(tuple(map(make, terms)))


def phrases(op) -> list[tuple[str, ...]]:
    """Phrases of two terms or more, excluded ones too."""
    if isinstance(op, Phrase):
        return [op.terms] if len(op.terms) > 1 else []
    if isinstance(op, (And, Or)):
        return [p for c in op.children for p in phrases(c)]
    return phrases(op.child) if isinstance(op, Not) else []


def _leaves(op, inside_not: bool):
    """Leaves that must or may be there, or with ``inside_not`` those under a Not."""
    if isinstance(op, (And, Or)):
        for c in op.children:
            if isinstance(c, Not):
                if inside_not:
                    yield from _all_leaves(c.child)
            else:
                yield from _leaves(c, inside_not)
    elif isinstance(op, Not):
        if inside_not:
            yield from _all_leaves(op.child)
    elif not inside_not:
        yield op


def _all_leaves(op):
    if isinstance(op, (And, Or)):
        for c in op.children:
            yield from _all_leaves(c)
    elif isinstance(op, Not):
        yield from _all_leaves(op.child)
    else:
        yield op


def leaves(op) -> list:
    return list(_all_leaves(op))


def _terms_of(leaf, expand, chars: bool):
    if isinstance(leaf, (Term, Fuzzy)):
        return [leaf.term]
    if isinstance(leaf, Phrase):
        return list(leaf.terms)
    if isinstance(leaf, Prefix):
        return expand(leaf.prefix)
    return list(leaf.chars) if chars else []


def include_terms(op, expand=lambda prefix: [prefix]) -> list[str]:
    """Sorted distinct terms that score; ``expand`` gives the index terms of a prefix."""
    return sorted({t for leaf in _leaves(op, False) for t in _terms_of(leaf, expand, True)})


def exclude_terms(op, expand=lambda prefix: [prefix]) -> list[str]:
    """Sorted distinct terms under a Not, without those of character matches."""
    return sorted({t for leaf in _leaves(op, True) for t in _terms_of(leaf, expand, False)})


def display_terms(op) -> list[str]:
    """Terms under an operator as explanations name them."""
    if isinstance(op, Prefix):
        return [f"{op.prefix}*"]
    if isinstance(op, (And, Or)):
        return [t for c in op.children for t in display_terms(c)]
    return display_terms(op.child) if isinstance(op, Not) else _terms_of(op, None, True)
