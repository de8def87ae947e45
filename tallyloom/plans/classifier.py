"""Fraud classifier: split, fit, score, measure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tallyloom.operators.model import accuracy, fit_forest, hash_split, predict
from tallyloom.operators.partitions import replicate_rows
from tallyloom.sources.datagen import BANKING_FEATURES


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    predictions: DataFrame
    scores: DataFrame


def train_and_score(df: DataFrame, key: Sequence[str], features: Sequence[str] = BANKING_FEATURES,
                    label: str = "fraud_trx", **settings) -> Trained:
    train, test = hash_split(df, key)
    model = fit_forest(train, features, label, **settings)
    predictions = predict(model, test)
    return Trained(model, predictions, accuracy(predictions, label))


def score_scaled(model: PipelineModel, df: DataFrame, features: Sequence[str], times: int = 1) -> DataFrame:
    """Predictions for the features of a table, each row scored ``times`` times; the label is not needed."""
    rows = df.select(*features)
    return predict(model, replicate_rows(rows, times) if times > 1 else rows)
