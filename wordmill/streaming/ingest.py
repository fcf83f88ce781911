"""Incremental indexing: a stream of documents becomes postings, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, text: str = "text", key: str = "doc_id", available_now: bool = False) -> StreamingQuery:
    """Append each batch's documents, lengths and postings under ``path``.

    A batch writes to a folder of its own number and replaces it when it is repeated after a failure, so no document
    is indexed twice. Statistics follow from the tables: a snapshot's scores are those of the batches in it."""

    def write(batch: DataFrame, number: int) -> None:
        built = Index.build(batch, text, key)
        for name, table in (("docs", built.docs), ("lengths", built.lengths), ("postings", built.postings)):
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def snapshot(spark: SparkSession, path: str) -> Index:
    """The index of all batches written so far."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch")
    return Index(read("docs"), read("postings"), read("lengths"))


def token_counts(stream: DataFrame, time: str, window: str, late: str, text: str = "text") -> DataFrame:
    """Counts of terms in windows of event time; a watermark bounds the state and drops later documents."""
    from ..functions.tokenize import terms

    seen = stream.withWatermark(time, late).select(F.window(time, window).alias("window"), F.explode(terms(F.col(text))).alias("term"))
    return seen.groupBy("window", "term").agg(F.count("*").alias("count"))
