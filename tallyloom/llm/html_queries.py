"""Registered query of the main-text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.html_text import extracted
from tallyloom.llm.registry import query, table


@query()
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))
