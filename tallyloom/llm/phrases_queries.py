"""Registered query of phrase mining, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.phrases import mined
from tallyloom.llm.registry import query, table

TOP, LEAST, COVERED = 2000, 10, 50

SQL = rf"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang,
    unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS length, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split),
f AS (SELECT lang, length, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE length = 1 GROUP BY lang),
c AS (SELECT lang, length, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE length > 1 AND f >= {LEAST}),
cuts AS (
  SELECT lang, phrase, a, length, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, length, 2, array_to_string(w[:2], ' '), w[3] FROM c WHERE length = 3),
valued AS (
  SELECT cuts.*, p.f AS l, q.f AS r, ((1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS sub FROM c WHERE length = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE length = 3)
  GROUP BY ALL),
left_over AS (SELECT lowest.* FROM lowest LEFT JOIN inner_of i ON i.lang = lowest.lang AND i.sub = phrase WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN n USING (lang) QUALIFY rank <= {TOP}
"""


@query(SQL)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return mined(table(spark, sf_dir, "documents"), TOP, LEAST, COVERED)
