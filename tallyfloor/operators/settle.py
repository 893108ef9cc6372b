"""Cutting lineage where a result is read several times, and dealing rows that are about to multiply."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the session names in ``spark.checkpoint.dir``.
    Only where it is unset, as in tests, a local one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a task makes where every row is repeated for each replicate.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``df`` by ``keys`` to so many tasks that each makes about ``TASK_ROWS`` of the ``rows`` that follow from it.

    The planner sizes tasks by the bytes they read and puts small ones together, so a step that repeats its rows
    hundreds of times would run in a few large tasks. The number is given, so these stay apart, and it grows with the rows."""
    least = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 50_000))
    return df.repartition(max(1, least, -(-rows // TASK_ROWS)), *keys)


def settle(df: DataFrame) -> DataFrame:
    """Write the frame once as a table in the shared folder and go on from there. The table
    outlives any executor, is computed a single time, and its file sizes tell the planner
    whether a later join may broadcast it."""
    spark = df.sparkSession
    path = scratch(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
