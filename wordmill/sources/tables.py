"""Reading documents of any file format, and keeping an index as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import spread
from ..operators.index import Index

FORMATS = ("parquet", "json", "csv", "text", "orc")


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A folder or file as a DataFrame, spread over the session's slots; ``text`` files give one document a line, or one a
    file with wholetext."""
    df = spread(spark.read.format(fmt).options(**options).load(path))
    return df.withColumnRenamed("value", "text") if fmt == "text" else df


def save_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Postings are range-partitioned and sorted by term, so that a query for a few terms reads the few row groups
    whose bounds hold them."""
    index.docs.write.mode(mode).parquet(f"{path}/docs")
    index.lengths.write.mode(mode).parquet(f"{path}/lengths")
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def attach_documents(results: DataFrame, source: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results with the source row of each as the struct ``item``; a result without one keeps a null item."""
    items = source.select(F.col(key).cast("long").alias("doc_id"), F.struct(*source.columns).alias("item"))
    return results.join(items, "doc_id", "left")
