"""A Bloom filter over 64-bit hashes, filled by Spark and asked by numpy.

It only keeps rows without a partner from being shuffled: the join behind it decides. It has 16 bits a key, or as many
as its user asks for, and two of them set, so 1.4 % of other keys pass; from 2**29 bits on it grows no more (64 MB in
each task), lets more rows through, and the result stays the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stash

#: Bits a key, and the least and most bits of a filter.
KEY_BITS, LEAST, MOST = 16, 1 << 20, 1 << 29


def fill(keys: DataFrame, key: Column, key_bits: int = KEY_BITS) -> np.ndarray:
    """The filter's bytes. Spark ors the bits by words of 64; the words that aren't 0 reach the driver, two for every
    key at most."""
    bits = min(MOST, max(LEAST, 1 << (key_bits * max(1, keys.count()) - 1).bit_length()))
    bit = keys.select(F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1))).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x")).toArrow()
    filled = np.zeros(bits // 64, dtype=np.int64)
    filled[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return filled.view(np.uint8)


def _set(filled: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (filled[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def may_hold(filled: np.ndarray, h: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of the hashes, of those that ``among`` marks, that the filter may hold."""
    low = np.uint64(8 * len(filled) - 1)
    at = np.flatnonzero(_set(filled, h & low) & among)
    return at[_set(filled, (h[at] >> np.uint64(32)) & low)]


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in the one column of ``gone``; null keys stay, as do all columns.

    Rows whose key the filter rules out aren't shuffled; the others go through an anti-join."""
    gone_name, may_name = fresh(docs, "gone", "may_go")
    gone = stash(gone.select(F.col(gone.columns[0]).cast("long").alias(gone_name)).where(F.col(gone_name).isNotNull()).distinct(), "gone")
    filled = fill(gone, F.xxhash64(gone_name))

    @F.pandas_udf("boolean")
    def may_go(h: pd.Series) -> pd.Series:
        out = np.zeros(len(h), dtype=bool)
        out[may_hold(filled, h.to_numpy(dtype=np.int64).view(np.uint64), np.ones(len(h), dtype=bool))] = True
        return pd.Series(out)

    marked = docs.withColumn(may_name, may_go(F.xxhash64(F.col(key).cast("long"))))
    rest = marked.where(F.col(may_name))
    kept = rest.join(gone, rest[key].cast("long") == gone[gone_name], "left_anti")
    return marked.where(~F.col(may_name)).unionByName(kept).drop(may_name)
