"""Query op9: line dedup over all documents; a document is a page, its source is the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lines import dedup_lines

NAME = "op9_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text")
    return dedup_lines(docs).select("doc_id", "clean", "n_lines", "n_dropped")


SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS k
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line),
bad AS (
  SELECT o.source, o.line FROM often o JOIN pages p ON o.source IS NOT DISTINCT FROM p.source
  WHERE o.n > 1 AND o.n > 0.1 * p.pages),
kept AS (
  SELECT l.*, b.line IS NOT NULL AS cut FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT cut), '') AS clean,
  count(*) AS n_lines, count(*) FILTER (cut) AS n_dropped
FROM kept GROUP BY doc_id
"""
