"""Query op6: all documents into eight shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .shards import shard_documents

NAME = "op6_sharding"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
