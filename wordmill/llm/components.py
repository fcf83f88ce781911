"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges(u, v)`` that is joined to a smaller one; root is the smallest id of the
    component. Loops and nulls are ignored. Each round is written to the shared folder, so a lost executor costs
    one round at most, and the number of rounds grows with the logarithm of the component size."""
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, mark = stash(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        step = stash(_small_star(_large_star(e)), "edges")
        drop(e)
        e, mark = step, now
