"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a folder of this machine, a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "lipika")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint: computed once, and not again if an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Bytes for each core below which a table is small.
SMALL_BYTES = 4_000_000


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores: its files may have fewer row groups than there are cores, and a row group is one task's work.

    Larger tables, and streams, stay as they are read; the size is the planner's estimate, which costs no job.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df
