"""Classifier queries on the line items: was the item returned?"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators import model as ops
from tallyloom.plans.classifier import score_scaled
from tallyloom.scratch import materialise, scratch_path
from tallyloom.workload.registry import query, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_BUCKET = "(l_orderkey * 31 + l_linenumber * 7) % 10000"
_RULE = "SELECT CAST(l_returnflag = 'R' AS INTEGER) AS returned, CAST(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM lineitem"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*KEY, *FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def _rule(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("returned", F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("prediction"))


def _fitted(spark: SparkSession, sf: str) -> tuple[PipelineModel, DataFrame]:
    train, test = ops.hash_split(_labelled(spark, sf), KEY)
    return ops.fit_forest(train, FEATURES, "returned"), test


@query(
    f"""SELECT CASE WHEN {_BUCKET} < 8000 THEN 'train' ELSE 'test' END AS side, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity
        FROM lineitem GROUP BY 1"""
)
def hash_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    bucket = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 10_000
    sides = zip(("train", "test"), ops.hash_split(table(spark, sf, "lineitem"), KEY, bucket=bucket))
    train, test = [
        part.agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")).select(F.lit(side).alias("side"), "*")
        for side, part in sides
    ]
    return train.unionByName(test)


@query(
    f"""WITH r AS ({_RULE}), l AS (SELECT returned, count(*) AS n, count(*) FILTER (WHERE prediction = returned) AS ok FROM r GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(ok) AS BIGINT) AS n_right, round(sum(ok)::DOUBLE / sum(n)::DOUBLE, 9) AS accuracy,
               round(max(n)::DOUBLE / sum(n)::DOUBLE, 9) AS majority_share FROM l"""
)
def accuracy_rule(spark: SparkSession, sf: str) -> DataFrame:
    return ops.accuracy(_rule(spark, sf), "returned").withColumns(
        {c: F.round(c, 9) for c in ("accuracy", "majority_share")}
    )


@query(f"SELECT returned, prediction, count(*) AS n_rows FROM ({_RULE}) GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return ops.confusion(_rule(spark, sf), "returned")


@query(f"SELECT count(*) AS n_rows FROM ({_RULE}) WHERE prediction = returned")
def matching_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _rule(spark, sf).filter("prediction = returned").agg(F.count("*").alias("n_rows"))


@query()
def rf_predict(spark: SparkSession, sf: str) -> DataFrame:
    forest, test = _fitted(spark, sf)
    return ops.predict(forest, test).select(*KEY, "returned", "prediction")


@query()
def rf_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The counted accuracy next to the evaluator's."""
    forest, test = _fitted(spark, sf)
    predictions = materialise(ops.predict(forest, test).select("returned", "prediction"), "predictions")
    return ops.accuracy(predictions, "returned").withColumn("evaluator", F.lit(ops.evaluator_accuracy(predictions, "returned")))


@query()
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted forest over every row, ten times."""
    forest, _ = _fitted(spark, sf)
    scored = score_scaled(forest, table(spark, sf, "lineitem"), FEATURES, times=10)
    return scored.groupBy("prediction").agg(F.count("*").alias("n_rows"))


@query("SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem) AS n_equal")
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the forest and of its stored copy, row by row."""
    forest, _ = _fitted(spark, sf)
    path = scratch_path(spark, "model")
    ops.save_model(forest, path)
    first = ops.predict(forest, table(spark, sf, "lineitem").select(*FEATURES)).withColumnRenamed("prediction", "first")
    second = ops.predict(ops.load_model(path), first)
    return second.agg(F.count("*").alias("n_rows"), F.count_if(F.col("first") == F.col("prediction")).alias("n_equal"))


@query("SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem) AS n_equal")
def rf_nodes_agree(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the fitted forest and of its table of nodes, row by row."""
    forest, _ = _fitted(spark, sf)
    first = ops.predict(forest, table(spark, sf, "lineitem").select(*FEATURES)).withColumnRenamed("prediction", "first")
    second = ops.predict_by_nodes(ops.forest_nodes(forest), first)
    return second.agg(F.count("*").alias("n_rows"), F.count_if(F.col("first") == F.col("prediction")).alias("n_equal"))


# Three small trees: quantity and discount, tax, quantity; votes for the classes 0 and 1.
_STUMPS = [
    (0, 0, "l_quantity", 25.0, 1, 2, None), (0, 1, None, None, None, None, [0.75, 0.25]), (0, 2, "l_discount", 0.05, 3, 4, None),
    (0, 3, None, None, None, None, [0.5, 0.5]), (0, 4, None, None, None, None, [0.125, 0.875]),
    (1, 0, "l_tax", 0.02, 1, 2, None), (1, 1, None, None, None, None, [0.25, 0.75]), (1, 2, None, None, None, None, [0.625, 0.375]),
    (2, 0, "l_quantity", 40.0, 1, 2, None), (2, 1, None, None, None, None, [0.5, 0.5]), (2, 2, None, None, None, None, [0.375, 0.625]),
]


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN l_quantity <= 25 THEN 0.25 WHEN l_discount <= 0.05 THEN 0.5 ELSE 0.875 END
              + CASE WHEN l_tax <= 0.02 THEN 0.75 ELSE 0.375 END + CASE WHEN l_quantity <= 40 THEN 0.5 ELSE 0.625 END AS ones FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN ones > 1.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM v"""
)
def nodes_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a given forest; equal votes go to the first class."""
    nodes = spark.createDataFrame(_STUMPS, ops.NODES)
    return ops.predict_by_nodes(nodes, _labelled(spark, sf)).select(*KEY, "prediction")
