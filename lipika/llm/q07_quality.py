"""Query op7: a quality score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import fit_quality, learning_fold, score_quality

NAME = "op7_quality_classifier"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, net)
    return scored.select("doc_id", (~learning_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
