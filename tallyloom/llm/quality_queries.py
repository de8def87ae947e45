"""Registered query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.quality import remainder, scored, train
from tallyloom.llm.registry import query, table

FOLDS, GOOD = 5, 0.3


@query()
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"), folds=FOLDS)
    held_out = remainder(F.col("doc_id"), FOLDS) == 0
    predicted = (F.col("score") >= GOOD).cast("int")
    return scored(docs, net).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))
