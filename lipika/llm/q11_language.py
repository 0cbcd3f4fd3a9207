"""Query op11: the language of every document, learned from four fifths of those that tell it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language import fit_language, identify_language, learning_fold

NAME = "op11_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = learning_fold(F.col("doc_id"))
    model = fit_language(docs.where(learn).select("text", "lang"))
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", (~learn & F.col("doc_id").isNotNull()).alias("held_out"), "lang_pred", "score")
