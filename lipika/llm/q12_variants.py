"""Query op12: spelling variants among the words of all documents, some of which have lost a letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .variants import count_words, damaged, runs, variants

NAME = "op12_spelling_variants"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return variants(count_words(found.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))))


SQL = r"""
WITH step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
once AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM run GROUP BY doc_id, w),
byte AS (SELECT doc_id, w, n, [CAST('0x' || x[2 * i - 1 : 2 * i] AS BIGINT) FOR i IN range(1, length(x) // 2 + 1)] AS b FROM once),
sum AS (SELECT doc_id, w, n, xor(list_reduce(b, lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM byte, step),
word AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 : ] ELSE w END AS w, n FROM sum)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
skip AS (SELECT w, i, w[1 : i - 1] || chr(1) || w[i + 1 : ] AS hole, w[1 : i - 1] || w[i + 1 : ] AS less FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM word)),
near AS (
  SELECT a.w, b.w AS o FROM skip a JOIN skip b ON a.hole = b.hole AND a.w <> b.w
  UNION SELECT s.w, v.w AS o FROM skip s JOIN word v ON s.less = v.w
  UNION SELECT v.w, s.w AS o FROM skip s JOIN word v ON s.less = v.w),
best AS (
  SELECT x.w, x.n, count(*) AS n_near, arg_max(o.w, (o.n, -o.r)) AS top, max(o.n) AS top_n
  FROM word x JOIN near ON near.w = x.w JOIN (SELECT w, n, row_number() OVER (ORDER BY w) AS r FROM word) o ON o.w = near.o GROUP BY x.w, x.n),
form AS (
  SELECT word.w, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * word.n THEN top END AS form, CASE WHEN top_n >= 2 * word.n THEN top_n END AS form_n
  FROM word LEFT JOIN best ON best.w = word.w),
chain AS (
  WITH RECURSIVE c AS (SELECT w, w AS at FROM form UNION ALL SELECT c.w, f.form AS at FROM c JOIN form f ON f.w = c.at WHERE f.form IS NOT NULL)
  SELECT c.w, c.at AS root FROM c JOIN form f ON f.w = c.at WHERE f.form IS NULL)
SELECT form.w AS word, form, root, n, n_near, form_n FROM form JOIN chain ON chain.w = form.w
"""
