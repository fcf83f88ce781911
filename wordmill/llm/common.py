"""Tables, the shared folder and identifiers used by every operator here."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch, ship, spread

_written: list[tuple[SparkSession, str]] = []
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage at a table that outlives executors.

    The shuffle files of the write are deleted when it has ended, for no later plan reads them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    if path := getattr(df, "stash_path", None):
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def written() -> set[str]:
    """Paths of the stashed tables that there are now."""
    return {path for _, path in _written}


def release(before: set[str], keep: DataFrame) -> None:
    """Delete what has been stashed since ``written`` gave ``before``, but for ``keep``: to be called when ``keep``, the
    only result that was wanted, has been stashed."""
    gone = written() - before - {keep.stash_path}
    for spark, path in [x for x in _written if x[1] in gone]:
        _delete(spark, path)
    _written[:] = [x for x in _written if x[1] not in gone]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def cleanup() -> None:
    """Delete every stashed table of this process; results that read them must have been written."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has gone, and its tables may have gone with it
            pass


atexit.register(cleanup)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
        taken.add(name)
    return out


def ids_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that operators read; rows with a null key or text take no part."""
    ship(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
