"""Registered query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.registry import query, table
from tallyloom.llm.secrets import KINDS, joined, with_spans


@query()
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of pattern spans, their digest, and all spans."""
    scanned = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
