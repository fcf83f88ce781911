"""The tree of a query as one boolean column, and as the reasons of a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rank import has_phrase
from .query import And, CharMatch, Fuzzy, Not, Or, Phrase, Prefix, Term, display_terms

REASON = "array<struct<code:string,message:string,terms:array<string>>>"


class Matcher:
    """``names`` is the array of a document's relevant terms, ``at`` the positions by term, ``expansions`` the index terms
    near a term, by (term, distance)."""

    def __init__(self, names: Column, at: dict[str, Column], expansions: dict[tuple[str, int], list[str]], term_distance: int = 0):
        self.names, self.at, self.expansions, self.term_distance = names, at, expansions, term_distance

    def has(self, term: str) -> Column:
        return F.array_contains(self.names, term)

    def _near(self, term: str, distance: int) -> list[str]:
        return self.expansions.get((term, distance), []) if distance else []

    def _any(self, term: str, distance: int) -> Column:
        near = self._near(term, distance)
        return F.arrays_overlap(self.names, F.array(*map(F.lit, [term, *near]))) if near else self.has(term)

    def matches(self, op) -> Column:
        """Not counts beside other children of And only; And of no others and Not alone match nothing, Or ignores it."""
        if isinstance(op, Term):
            return self._any(op.term, self.term_distance)
        if isinstance(op, Fuzzy):
            return self._any(op.term, op.distance)
        if isinstance(op, Phrase):
            return self._phrase(op)
        if isinstance(op, Prefix):
            return F.exists(self.names, lambda t: t.startswith(op.prefix))
        if isinstance(op, CharMatch):
            return _all([self.has(c) for c in op.chars])
        if isinstance(op, And):
            keep = [c for c in op.children if not isinstance(c, Not)]
            out = [c.child for c in op.children if isinstance(c, Not)]
            return _all([self.matches(c) for c in keep] + [~self.matches(c) for c in out]) if keep else F.lit(False)
        if isinstance(op, Or):
            found = F.lit(False)
            for c in op.children:
                if not isinstance(c, Not):
                    found = found | self.matches(c)
            return found
        return F.lit(False)

    def _phrase(self, op: Phrase) -> Column:
        return has_phrase(self.at, op.terms)

    def reasons(self, op) -> Column:
        """Why a document that matches does, each reason once."""
        found = F.filter(F.array(*self._reasons(op, F.lit(True))), lambda r: r.isNotNull()) if self._reasons(op, F.lit(True)) else F.array().cast(REASON)
        return F.when(self.matches(op), F.array_distinct(found)).otherwise(F.array().cast(REASON))

    def _reasons(self, op, when: Column) -> list[Column]:
        def give(on: Column, code: str, message: str, terms: Column | list[str]) -> Column:
            return F.when(when & on, reason(code, message, terms))

        if isinstance(op, (Term, Fuzzy)):
            near = self._near(op.term, self.term_distance if isinstance(op, Term) else op.distance)
            out = [give(self.has(op.term), "term", f"document contains term '{op.term}'", [op.term])]
            return out + [
                give(~self.has(op.term) & self.has(e), "fuzzy", f"fuzzy match: '{op.term}' matched index term '{e}'", [op.term, e]) for e in near
            ]
        if isinstance(op, Phrase):
            return [give(self._phrase(op), "phrase", f"document contains consecutive phrase '{' '.join(op.terms)}'", list(op.terms))]
        if isinstance(op, Prefix):
            matched = F.filter(self.names, lambda t: t.startswith(op.prefix))
            return [give(F.size(matched) > 0, "prefix", f"document matches prefix '{op.prefix}'", matched)]
        if isinstance(op, CharMatch):
            return [give(_all([self.has(c) for c in op.chars]), "char", f"document contains characters: {', '.join(op.chars)}", list(op.chars))]
        if isinstance(op, And):
            keep = [c for c in op.children if not isinstance(c, Not)]
            out = [give(F.lit(True), "and", f"document satisfies AND of {len(keep)} clauses", [])] if keep else []
            for c in keep:
                out += self._reasons(c, when)
            for c in op.children:
                if isinstance(c, Not):
                    terms = display_terms(c.child)
                    out.append(give(~self.matches(c.child), "not", f"document does not match excluded terms: {', '.join(terms)}", terms))
            return out
        if isinstance(op, Or):
            branches = [c for c in op.children if not isinstance(c, Not)]
            out = [give(self.matches(op), "or", "document satisfies at least one OR branch", [])] if branches else []
            for c in branches:
                out += self._reasons(c, when & self.matches(c))
            return out
        return []


def reason(code: str, message: str | Column, terms: Column | list[str]) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    names = terms if isinstance(terms, Column) else F.array(*map(F.lit, terms)).cast("array<string>")
    return F.struct(F.lit(code).alias("code"), text.alias("message"), names.alias("terms"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


