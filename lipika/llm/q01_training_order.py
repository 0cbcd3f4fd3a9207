"""Query op1: all documents as token-id shards in training order; returns the index of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .training_order import shard_folder, training_order

NAME = "op1_token_id_output"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return training_order(docs, shard_folder(docs), key=20240229)
