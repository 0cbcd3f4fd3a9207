"""Query op10: near-duplicate components over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import spread
from .common import table
from .neardup import near_duplicates

NAME = "op10_minhash_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
