"""Query op5: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import spread
from .common import table
from .packing import pack

NAME = "op5_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
