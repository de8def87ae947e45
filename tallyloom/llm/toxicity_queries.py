"""Registered query of the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.registry import query, table
from tallyloom.llm.toxicity import remainder, scored, train

FOLDS = 5


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), folds=FOLDS)
    held_out = remainder(F.col("doc_id"), FOLDS) == 0
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))
