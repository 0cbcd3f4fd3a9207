"""Word counters over event tables: the batch twins of the streaming ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_second(events: DataFrame, action: str = "addWord") -> DataFrame:
    """``sec, n``: events of one action by second."""
    return events.where(F.col("action") == action).groupBy(F.date_trunc("second", "ts").alias("sec")).agg(F.count("*").alias("n"))


def running_total(events: DataFrame, start: int = 0, action: str = "addWord") -> DataFrame:
    """``sec, n, total``: the running total at the end of each second with events.

    Only seconds are ordered, not events, and in two steps: totals of hours, then within an hour,
    so no task orders more than the hours or one hour's seconds.
    """
    seconds = per_second(events, action).withColumn("hour", F.date_trunc("hour", "sec"))
    hours = seconds.groupBy("hour").agg(F.sum("n").alias("h"))
    ahead = F.sum("h").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    base = hours.select("hour", (F.coalesce(ahead, F.lit(0)) + start).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("hour").orderBy("sec"))
    return seconds.withColumn("inside", inside).join(base, "hour").select("sec", "n", (F.col("base") + F.col("inside")).alias("total"))


def last_seconds(events: DataFrame, k: int = 10, start: int = 0, action: str = "addWord") -> DataFrame:
    """The last k seconds that had events with the total at the end of each, oldest first."""
    return running_total(events, start, action).orderBy(F.desc("sec")).limit(k).orderBy("sec")


def log_counts(logs: DataFrame, *by: str) -> DataFrame:
    return logs.groupBy(*by).agg(F.count("*").alias("n"))
