"""Registered query of byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.bpe import encoded
from tallyloom.llm.registry import query, table

RANKS = "byte_bpe_50k.tiktoken"


@query()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
