"""Registered query of LM scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.lm import scored
from tallyloom.llm.registry import query, table


@query()
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the base model and under the interpolated one."""
    return scored(table(spark, sf_dir, "documents"))
