"""Registered query of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.mixing import rates
from tallyloom.llm.registry import query, table

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap
  FROM totals),
steps AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - COALESCE(sum(cap) OVER o, 0)) / (sum(weight) OVER () - COALESCE(sum(weight) OVER o, 0)) AS per_weight
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT per_weight FROM steps WHERE per_weight <= ratio ORDER BY ratio, per_weight LIMIT 1),
targets AS (SELECT source, source_size, LEAST(cap, (SELECT per_weight FROM level) * weight) AS target FROM steps),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || COALESCE(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


@query(SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    mixed = rates(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
