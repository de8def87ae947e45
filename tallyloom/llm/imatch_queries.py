"""Registered query of I-Match fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.imatch import compared
from tallyloom.llm.registry import query, table


@query()
def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return compared(table(spark, sf_dir, "documents"))
