"""Query op2: which documents hold which benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import spread
from .common import table
from .decontaminate import contaminated

NAME = "op2_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
