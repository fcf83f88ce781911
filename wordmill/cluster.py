"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session once, so that functions of it run on executors that don't have it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="wordmill-package-"), "wordmill.zip")
    Path(path).write_bytes(made.getvalue())
    sc.addPyFile(path)  # the driver serves the file to every executor, later ones too
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a folder of our own on a local master;
    on a cluster the executors would not share it, and that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="wordmill-")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/wordmill-{uuid.uuid4().hex[:12]}-{name}"


def spread(scan: DataFrame) -> DataFrame:
    """A table as it is read, in one partition a slot if it comes in fewer: a file of one row group is one task's work,
    however many slots wait. A table of a cluster's size comes in more partitions and is left as it is."""
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan
