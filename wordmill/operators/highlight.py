"""Highlighting: merged byte spans of terms, wrapped in tags, over the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pieces, tokenize
from ..options import HighlighterConfig


def merge_rows(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end): spans of one row each; those that overlap become one, those that only touch stay apart."""
    by = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") < reach, 0).otherwise(1)
    runs = spans.withColumn("new", new).withColumn("run", F.sum("new").over(by))
    return runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def wrap(text: Column, merged: Column, config: HighlighterConfig = HighlighterConfig()) -> Column:
    """The text with its spans, in order and apart, in tags; null if there are none. Slices are of UTF-8 bytes."""

    def tagged(data: Column) -> Column:
        cut = lambda a, b: F.decode(F.substring(data, a + 1, b - a), "UTF-8")

        def part(s: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(merged, k - 1)["end"]).otherwise(F.lit(0))
            return F.concat(cut(before, s["start"]), F.lit(config.open_tag), cut(s["start"], s["end"]), F.lit(config.close_tag))

        return F.concat(F.array_join(F.transform(merged, part), ""), cut(F.element_at(merged, -1)["end"], F.octet_length(data)))

    return F.when(F.size(merged) > 0, tokenize.let(F.encode(text, "UTF-8"), tagged))


def highlight(docs: DataFrame, terms: list[str], config: HighlighterConfig = HighlighterConfig()) -> DataFrame:
    """(doc_id, highlighted, start, end, original) of each document that has one of the terms."""
    merged = pieces.spans(docs.select("doc_id", "text"), terms).where(F.size("merged") > 0)
    return merged.select(
        "doc_id",
        wrap(F.col("text"), F.col("merged"), config).alias("highlighted"),
        F.element_at("merged", 1)["start"].alias("start"),
        F.element_at("merged", -1)["end"].alias("end"),
        F.col("text").alias("original"),
    )
