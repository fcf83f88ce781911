"""Cleaning of a training corpus, stage by stage; each stage is written and read again before the next one.

A row with a null doc_id or a null text passes the filtering stages unchanged and is not packed, nor is a text without a
word. Rows that repeat a doc_id share the fate of the id in deduplication and decontamination; each of them is scored,
masked and packed by itself. Columns beside doc_id, text and n_chars are carried along and never read, whatever their
names. With empty ``labels`` or ``benchmark`` their stages keep every row; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmill.llm import decontaminate, minhash, packing, pii, toxicity
from wordmill.llm.common import release, stash, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on ``labels`` and their texts in ``docs``, rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return minhash.drop_near_duplicates(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of ``benchmark`` go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data in the texts is replaced by its kind in brackets; n_chars follows."""
    return pii.mask_private(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence of each piece of each document that is left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate_documents),
    ("pii", mask_private),
    ("best_fit_packing", pack),
]

#: The stages hold trained models, estimates and a randomized search, which SQL can't express; tests hold the stages
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = written() - {getattr(docs, "stash_path", "")}
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
            release(before, docs)  # the stage's input and its tables
    return docs
