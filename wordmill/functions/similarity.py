"""String similarity: edit distances, Jaccard, longest common subsequence and ranked fuzzy matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

MOST_EDITS, DEFAULT_MATCHES = 3, 64


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def is_fuzzy_match(a: Column, b: Column, distance: int) -> Column:
    return F.levenshtein(a, b) <= distance


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _damerau(a: str, b: str) -> int:
    """Unrestricted: a transposed pair may be edited further."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    row_of: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, m = row_of.get(b[j - 1], 0), column
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, column = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        row_of[a[i - 1]] = i
    return d[len(a), len(b)]


def _lcs(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(len(a), len(b))


def _pairwise(a: pd.Series, b: pd.Series, f) -> pd.Series:
    memo: dict = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in memo:
            memo[pair] = None if pair[0] is None or pair[1] is None else f(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype=object)


def damerau_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance with transpositions. No built-in function has them: Arrow batches, each distinct pair once."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return _pairwise(x, y, _damerau)

    return distance(a, b)


def lcs_similarity(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence over that of the longer string; 0 if one is empty."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return _pairwise(x, y, _lcs)

    return share(a, b)


def register(df: DataFrame) -> DataFrame:
    """Ship the package to the session of ``df``, which the two Pandas functions need."""
    ship(df.sparkSession)
    return df


def fuzzy_matches(vocabulary: DataFrame, term: str, distance: int = 2, limit: int | None = DEFAULT_MATCHES) -> DataFrame:
    """(term, distance, score) of the vocabulary's terms within min(distance, 3) edits, best first, ties by term.

    The band of lengths is tested before the edit distance, which stops at its threshold."""
    if not term or limit == 0:
        return vocabulary.sparkSession.createDataFrame([], "term string, distance int, score double")
    distance = most = min(distance, MOST_EDITS)
    n = F.lit(len(term))
    size = F.char_length("term")
    near = vocabulary.select("term").where(F.abs(size - n) <= distance).withColumn("distance", F.levenshtein("term", F.lit(term), most)).where("distance >= 0")
    score = (F.lit(1.0) - F.col("distance") / F.lit(float(max(most, 1)))) * 0.7 + F.least(size, n) / F.greatest(size, n) * 0.3
    found = near.withColumn("score", score).orderBy(F.desc("score"), "term")
    return found if limit is None else found.limit(limit)


def fuzzy_matches_with_prefix(vocabulary: DataFrame, term: str, distance: int = 2, limit: int | None = DEFAULT_MATCHES) -> DataFrame:
    """``fuzzy_matches`` with half as much again for terms that begin with the query."""
    found = fuzzy_matches(vocabulary, term, distance, limit)
    return found.withColumn("score", F.when(F.col("term").startswith(term), F.col("score") * 1.5).otherwise(F.col("score"))).orderBy(F.desc("score"), "term")
