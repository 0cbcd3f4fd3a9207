"""Query op13: the best collocations of each language, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .phrases import phrases

NAME = "op13_phrase_collocations"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
word AS (
  SELECT id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
run AS (
  SELECT lang, i, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4, lead(w, 4) OVER s AS w5
  FROM word WINDOW s AS (PARTITION BY id ORDER BY i)),
gram AS (
  SELECT lang, [w1] AS g FROM run
  UNION ALL SELECT lang, [w1, w2] FROM run WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM run WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4] FROM run WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM run WHERE w5 IS NOT NULL),
f AS (SELECT lang, g, count(*) AS n FROM gram GROUP BY lang, g HAVING count(*) >= 100),
cand AS (SELECT lang, g, n AS a FROM f WHERE len(g) > 1),
place AS (SELECT unnest([1, 1, 1, 1, 2, 2, 2, 3, 3, 4]) AS i, unnest([2, 3, 4, 5, 3, 4, 5, 4, 5, 5]) AS j),
inner_of AS (
  SELECT DISTINCT c.lang, c.g FROM (
    SELECT lang, a, g[i : j] AS g FROM cand JOIN place ON j <= len(cand.g) AND j - i + 1 < len(cand.g)) x
  JOIN cand c ON c.lang = x.lang AND c.g = x.g WHERE 100 * x.a >= 100 * c.a),
cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, l.n AS l, r.n AS r, t.n AS n,
    CAST((1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM cut c JOIN total t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1 : ]),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM least ANTI JOIN inner_of USING (lang, g))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""
