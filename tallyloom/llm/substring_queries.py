"""Registered query of the repeated-substring removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.registry import query, table
from tallyloom.llm.substrings import without_repeats


@query()
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat."""
    return without_repeats(table(spark, sf_dir, "documents"))
