"""Scores as expressions over a document's matched entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tokenize import let
from ..options import Bm25Params

#: Numbers of terms between which proximity counts.
PROXIMITY_TERMS = range(2, 17)


def idf(df: Column, n: Column) -> Column:
    return F.when(df > 0, F.log1p((n + 0.5 - df) / (0.5 + df))).otherwise(F.lit(0.0))


def bm25_part(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, params: Bm25Params = Bm25Params()) -> Column:
    """One term's share of BM25."""
    norm = tf + params.k1 * (1.0 - params.b + params.b * dl / avgdl)
    return F.when(avgdl > 0, idf(df, n) * (tf * (params.k1 + 1.0)) / norm).otherwise(F.lit(0.0))


def tfidf_part(tf: Column, df: Column, n: Column) -> Column:
    return F.when((tf > 0) & (df > 0), (1.0 + F.log(tf)) * F.log(n / df)).otherwise(F.lit(0.0))


def _closest(p: Column, q: Column) -> Column:
    """Least distance of two sorted position arrays: in their merged order it lies between neighbours of unlike
    origin, so the cost is that of a sort, not of all pairs."""
    mark = lambda x, side: F.transform(x, lambda v: F.struct(v.alias("v"), F.lit(side).alias("s")))

    def least(both: Column) -> Column:
        n = F.size(both)
        gaps = F.zip_with(F.slice(both, F.lit(1), n - 1), F.slice(both, F.lit(2), n - 1), lambda a, b: F.when(a["s"] != b["s"], b["v"] - a["v"]))
        return F.array_min(gaps)

    return let(F.array_sort(F.concat(mark(p, 0), mark(q, 1))), least)


def proximity(entries: Column, count: int) -> Column:
    """Mean over the pairs of terms that occur together of 1 / (least distance + 1)."""
    if count not in PROXIMITY_TERMS:
        return F.lit(0.0)
    n = F.size(entries)
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(F.slice(entries, i + 1, n - i), lambda y: 1.0 / (_closest(F.element_at(entries, i)["positions"], y["positions"]) + 1)),
        )
    )
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    return F.when(n >= 2, total / F.size(pairs)).otherwise(F.lit(0.0))


def _minus(positions: Column, k: int) -> Column:
    return F.transform(positions, lambda x: x - k)


def has_phrase(at: dict[str, Column], terms: tuple[str, ...]) -> Column:
    """Whether the terms follow one another: the intersection of their positions, each moved to the first term's."""
    if len(terms) == 1:
        return F.size(at[terms[0]]) > 0
    moved = at[terms[0]]
    for k, t in enumerate(terms[1:], 1):
        moved = F.array_intersect(moved, _minus(at[t], k))
    return F.size(moved) > 0


def coverage(matched: Column, count: int, bm25: Column) -> Column:
    return F.when((bm25 > 0) & F.lit(count > 0), matched / max(count, 1) * bm25 * 0.2).otherwise(F.lit(0.0))


def proximity_weight(bm25: Column) -> Column:
    return 0.45 * (1.0 + F.least(F.log1p(bm25), F.lit(2.0)))


