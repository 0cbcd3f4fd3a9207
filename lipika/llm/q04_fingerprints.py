"""Query op4: fingerprints of all documents, of their edited texts, and how alike they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprints import fingerprint_pairs

NAME = "op4_fingerprints"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
