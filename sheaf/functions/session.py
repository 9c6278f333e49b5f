"""Session settings and reliable cut points."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # reviews are built of thousands of column expressions; noting the call site of each takes longer than planning them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Intermediate tables of this process, in the order they were written.
_WRITTEN: list[str] = []


def builder(app: str = "sheaf", **settings: str) -> SparkSession.Builder:
    """A session builder with the settings the operators expect."""
    out = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        out = out.config(key, value)
    return out


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (``local[n]``)
    gets a folder of its own where the setting is missing; on any cluster that
    is an error.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        where = tempfile.mkdtemp(prefix="sheaf-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Computes a table once and reads it back from the shared folder.

    For tables that many later steps read, and for calls out of Spark that
    must not repeat.  The copy outlives lost executors and keeps column
    pruning, filter pushdown and size statistics.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.partitionBy(*partition_by).parquet(path)
    _WRITTEN.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def merged(df: DataFrame) -> DataFrame:
    """A table whose joins are merge joins, however small its files.

    For stored tables with a row per key or more.  Spark takes their size to be
    that of the files times the share of the columns read, which for a few
    columns of a wide table is a small part of the rows' size in memory, and a
    side that it takes to be small goes whole through the driver.
    """
    return df.hint("merge")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows at once between the JVM and Python, for what is computed inside the block.

    Batches are counted in rows, so with long texts the default of 10,000 holds
    many megabytes on both sides of each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_tables() -> int:
    """A mark for :func:`drop_tables`."""
    return len(_WRITTEN)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Removes the intermediate tables written after a mark, once their results are stored.

    What was read from them and not stored yet cannot be computed any more.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
