"""Range sharding with sampled splitters: size-weighted quantiles of the key, overfull ranges cut again."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from .common import drop, fresh, stash

#: Bytes of text that a shard should hold, shards that a range between splitters should fill, and keys drawn for each
#: splitter.
SHARD_BYTES, RANGE, DRAWS = 32 << 20, 2, 32


def sort_key(columns: list[str], docs: DataFrame):
    """One binary whose order is the order of the columns: nulls first, whole numbers by value, others as text. Rows
    with equal columns are told apart, so a key as large as many shards can be cut, by a hash of the row's number."""
    kinds, parts = dict(docs.dtypes), []
    for c in columns:
        if kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            v = F.col(c).cast("long")
            flipped = F.lpad(F.hex(v.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
            parts.append(F.coalesce(F.concat(F.lit("1"), flipped), F.lit("0")))
        else:
            text = F.regexp_replace(F.col(c).cast("string"), "\u0000", "\u0000\u0001")
            parts.append(F.coalesce(F.concat(F.lit("1"), text), F.lit("0")))
    tie = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")
    return F.concat_ws("\u0000\u0000", *parts, tie).cast("binary")


def splitters(keys: DataFrame, total: int, range_bytes: int) -> list[bytes]:
    """Upper ends of all ranges but the last. Keys are drawn with probability in proportion to their rows' sizes, by
    a hash of the row and not by chance: the same table gives the same splitters. A row larger than the sampling step
    counts as often as it holds the step. Spark sorts the drawn keys and sums their weights; the ends alone, one to
    each range, reach the driver."""
    ranges = max(1, math.ceil(total / range_bytes))
    if ranges == 1:
        return []
    step = total / (DRAWS * ranges)
    luck = F.pmod(F.xxhash64("key", "size", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.withColumn("times", F.floor(F.col("size") / F.lit(step) + luck)).where("times > 0").select("key", "times")
    part = stash(drawn.repartitionByRange("key").select("*", F.spark_partition_id().alias("part")), "drawn")
    weights = {r.part: r.w for r in part.groupBy("part").agg(F.sum("times").alias("w")).collect()}
    before, weight = {}, 0
    for k in sorted(weights):
        before[k] = weight
        weight += weights[k]
    if not weight:
        return []
    base = keys.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    so_far = F.sum("times").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    quantile = lambda w: F.floor(w * F.lit(ranges) / F.lit(weight))
    at = part.join(F.broadcast(base), "part").withColumn("now", so_far)  # a row a partition
    ends = at.where((quantile(F.col("now")) > quantile(F.col("now") - F.col("times"))) & (F.col("now") < weight)).select("key").toArrow()
    drop(part)
    return sorted(set(ends.column("key").to_pylist()))


def shards(docs: DataFrame, columns: tuple[str, ...] = ("source", "doc_id"), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every row and column of ``docs``, with shard_id, range-partitioned and sorted by shard and key.

    The key is made of ``columns`` in order. Ranges are (splitter before, splitter] and should hold two shards; a range
    is cut into equal parts of at most ``shard_bytes`` by the running size of its rows in key order, so a shard is larger
    by a part of one row at most. shard_id counts from 0 in key order; a text as large as several shards leaves the
    numbers after its own unused.

    Nulls in key columns sort first; a null text has size 0. Rows with equal keys, repeated rows too, lie together, and
    are cut like any others when a range is overfull. Columns of ``docs`` keep their names and values, whatever they are
    called; only shard_id is replaced if it exists. Very long texts stay whole. An empty table gives an empty result.

    ``docs`` is computed twice. Row numbers tell equal keys apart, so they should be the same each time, as those of a scan
    are; where they aren't, the row at a splitter may change sides, and a shard be larger by it.

    The driver and each task hold the end, size and first shard of every range: some 80 bytes for 64 MB of text."""
    ship(docs.sparkSession)
    docs = docs.drop("shard_id")
    key_name, size_name, at_name = fresh(docs, "key", "size", "at")
    named = docs.withColumns({key_name: sort_key(list(columns), docs), size_name: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    keys = stash(named.select(F.col(key_name).alias("key"), F.col(size_name).alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ends = np.array(splitters(keys, total, RANGE * shard_bytes), dtype=bytes)

    @F.pandas_udf("long")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, np.array(key.tolist(), dtype=bytes)) if len(ends) else np.zeros(len(key), np.int64))

    got = keys.groupBy(range_of("key").alias("range")).agg(F.sum("size").alias("bytes")).toArrow()  # a row a range
    drop(keys)
    held = np.zeros(len(ends) + 1, dtype=np.int64)
    held[got.column("range").to_numpy()] = got.column("bytes").to_numpy()
    cuts = np.maximum(1, -(-held // shard_bytes))
    first = np.cumsum(cuts) - cuts

    @F.pandas_udf("struct<range: int, first: long, cuts: long, bytes: long>")
    def place(key: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(ends, np.array(key.tolist(), dtype=bytes)) if len(ends) else np.zeros(len(key), np.int64)
        return pd.DataFrame({"range": at.astype(np.int32), "first": first[at], "cuts": cuts[at], "bytes": np.maximum(1, held[at])})

    at = F.col(at_name)
    placed = named.withColumn(at_name, place(key_name)).repartitionById(len(cuts), at["range"])  # a range a partition
    before = F.sum(size_name).over(Window.partitionBy(at["range"]).orderBy(key_name).rowsBetween(Window.unboundedPreceding, -1))
    part = F.least(F.floor(F.coalesce(before, F.lit(0)) * at["cuts"] / at["bytes"]), at["cuts"] - 1)
    return placed.withColumn("shard_id", (at["first"] + part).cast("int")).drop(key_name, size_name, at_name)
