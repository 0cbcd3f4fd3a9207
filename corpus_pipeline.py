"""Corpus pipeline over ``documents``: each stage is one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns what goes on. All but the last return the columns
of ``documents`` (doc_id, text, lang, source, n_chars). Each is judged by its operator's docstring
for nulls, ties, repeated rows and empty tables. Columns beyond these five end with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import materialize, table
from lipika.llm.decontaminate import contaminated
from lipika.llm.lines import dedup_lines
from lipika.llm.neardup import near_duplicates
from lipika.llm.packing import pack
from lipika.llm.quality import fit_quality, score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under one half) go."""
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), net).where("score >= 0.5").select(*COLUMNS)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in more than a tenth of a source's documents are cut out; all documents stay."""
    done = dedup_lines(docs.select(*COLUMNS, F.col("source").alias("host")))
    return done.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.char_length("clean").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once."""
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    whole = F.struct("text", "lang", "source", "n_chars")
    # of rows that repeat a doc_id one stays; rows without a doc_id all stay
    once = docs.join(found, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(whole).alias("d")).select("doc_id", "d.*")
    return once.unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = docs.select(*COLUMNS)
    bad = materialize(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 tokens with the corpus's mixture of sources."""
    return pack(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_boilerplate),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The first, third, fourth and fifth stages are beyond SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
