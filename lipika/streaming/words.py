"""Word counters, suggestions and transliteration over streams.

A stream's results are tables with a folder for each batch, written over when a batch is run again; so
a restart, or a batch that failed half-way, adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import predict
from ..plans.jobs import transliterate_text


def stream_word_counts(events: DataFrame, action: str = "addWord", late: str = "10 seconds") -> DataFrame:
    """(ts, action) events of one action by second of event time; rows later than the watermark are dropped."""
    return events.where(F.col("action") == action).withWatermark("ts", late).groupBy(F.window("ts", "1 second").alias("w")).count().select(F.col("w.start").alias("sec"), F.col("count").alias("n"))


def stream_running_total(events: DataFrame, start: int = 0, action: str = "addWord") -> DataFrame:
    """The total so far; Spark's checkpoint carries it over restarts. Output mode complete or update."""
    return events.where(F.col("action") == action).groupBy().agg((F.count("*") + start).alias("total"))


def by_batch(stream: DataFrame, path: str, checkpoint: str, done: Callable[[DataFrame], DataFrame] = lambda rows: rows, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there, each batch's rows through ``done`` into a folder of its own below ``path``."""

    def put(rows: DataFrame, batch: int) -> None:
        done(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def count_words(events: DataFrame, path: str, checkpoint: str, action: str = "addWord", late: str = "10 seconds") -> StreamingQuery:
    """Keep the counts by second of (ts, action) events: each batch writes the seconds it changed, with their counts so far."""
    return by_batch(stream_word_counts(events, action, late), path, checkpoint, mode="update")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``sec, n``: the last count of each second."""
    last = F.max_by("n", "batch")
    return spark.read.schema("sec timestamp, n long, batch long").parquet(path).groupBy("sec").agg(last.alias("n"))


def add_to_total(events: DataFrame, path: str, checkpoint: str, action: str = "addWord") -> StreamingQuery:
    """Count the events of one action batch by batch."""
    return by_batch(events.where(F.col("action") == action), path, checkpoint, lambda rows: rows.agg(F.count("*").alias("n")))


def read_total(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """``total``: the stored start and all batches."""
    return spark.read.schema("n long, batch long").parquet(path).agg((F.coalesce(F.sum("n"), F.lit(0)) + start).alias("total"))


def stream_transliterate(docs: DataFrame, lang: str) -> DataFrame:
    """(doc_id, text) in native script, row by row: no state."""
    return transliterate_text(docs, lang)


def suggest_words(words: DataFrame, lang: str, path: str, checkpoint: str, **models) -> StreamingQuery:
    """Suggestions for the different words of each batch of (word) rows; ``models`` are static tables, as in ``suggest``."""
    return by_batch(words.select("word"), path, checkpoint, lambda rows: predict.suggest(rows, lang, **models))


def append_feedback(words: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append taught (wkey, wvalue, language, mode) rows to a Parquet table, each batch once."""
    rows = words.select("wkey", "wvalue", "language", "mode")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
