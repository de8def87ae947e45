"""Classifier steps on ``pyspark.ml``: split, fit, score, accuracy, save and load."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def hash_split(
    df: DataFrame, key: Sequence[str], train_share: float = 0.8, seed: int = 1234, bucket: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, decided by the row's key alone.

    The same row always lands on the same side, whatever the partitioning.
    ``bucket`` may replace the hash by any whole number in 0..9999.
    """
    if bucket is None:
        bucket = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_000))
    train = bucket < F.lit(round(train_share * 10_000))
    return df.where(train), df.where(~train)


def forest_stages(features: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed: int = 1234) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[assembler, forest])


def fit_forest(train: DataFrame, features: Sequence[str], label: str, **settings) -> PipelineModel:
    """Random forest on scalar columns; only the columns it needs are read.

    Rows with a missing feature are not learned from; the fitted model keeps them when it scores.
    """
    fitted = forest_stages(features, label, **settings).fit(train.select(*features, label))
    fitted.stages[0].setHandleInvalid("keep")
    return fitted


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every row with a ``prediction``, null where a feature is null or NaN; the vector columns are dropped again."""
    missing = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in model.stages[0].getInputCols()]
    scored = model.transform(df).drop("probability", "rawPrediction", "features")
    return scored.withColumn("prediction", F.when(~reduce(or_, missing), F.col("prediction")))


NODES = "tree int, node int, feature string, threshold double, low int, high int, votes array<double>"


def forest_nodes(model: PipelineModel) -> DataFrame:
    """The fitted forest as a table, one row per node; node 0 is the root of its tree.

    A row whose ``feature`` is at most ``threshold`` goes on to node ``low``,
    otherwise to ``high``. Leaves have ``votes``, the share of each class. The
    table has at most ``trees * 2 ** (depth + 1)`` rows.
    """
    names, rows = model.stages[0].getInputCols(), []
    for number, tree in enumerate(model.stages[-1].trees):
        waiting, made = [tree._call_java("rootNode")], 0
        while waiting:
            node = waiting.pop(0)
            at, open_rows = made, len(waiting)
            made += 1
            if node.subtreeDepth():
                split = node.split()
                low = made + open_rows  # children follow all nodes that wait already
                rows.append((number, at, names[split.featureIndex()], split.threshold(), low, low + 1, None))
                waiting += [node.leftChild(), node.rightChild()]
            else:
                counts = list(node.impurityStats().stats())
                whole = sum(counts)
                rows.append((number, at, None, None, None, None, [c / whole if whole else 0.0 for c in counts]))
    return SparkSession.active().createDataFrame(rows, NODES)


def predict_by_nodes(nodes: DataFrame, df: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """Every row with the ``prediction`` of a forest given as nodes; null where a required feature is null or NaN.

    By default the features that the nodes ask for are required; :func:`predict`
    requires all it was fitted on.

    Trees become nested conditions in compiled code, without vectors. The class
    with the largest sum of votes wins, the first of equal ones.
    """
    trees: dict[int, dict] = {}
    for row in nodes.collect():  # bounded by the size of the forest
        trees.setdefault(row["tree"], {})[row["node"]] = row
    asked = {n["feature"] for tree in trees.values() for n in tree.values() if n["feature"] is not None}
    features = sorted(asked if required is None else asked | set(required))

    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def rule(tree: dict, at: int) -> str:
        n = tree[at]
        if n["feature"] is None:
            return "array(" + ", ".join(f"{v!r}D" for v in n["votes"]) + ")"
        return f"if(CAST({quoted(n['feature'])} AS double) <= {n['threshold']!r}D, {rule(tree, n['low'])}, {rule(tree, n['high'])})"

    columns = [f"_tree{t}" for t in sorted(trees)]
    voted = df.selectExpr("*", *[f"{rule(trees[t], 0)} AS _tree{t}" for t in sorted(trees)])
    classes = max(len(n["votes"]) for tree in trees.values() for n in tree.values() if n["votes"] is not None)
    sums = ", ".join(" + ".join(f"{c}[{k}]" for c in columns) for k in range(classes))
    voted = voted.selectExpr(*[quoted(c) for c in df.columns], f"array({sums}) AS _votes")
    best = F.expr("CAST(array_position(_votes, array_max(_votes)) - 1 AS double)")
    missing = [F.col(quoted(c)).isNull() | F.isnan(F.col(quoted(c)).cast("double")) for c in features]
    known = F.when(~reduce(or_, missing), best) if missing else best
    return voted.withColumn("prediction", known).drop("_votes")


def accuracy(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Share of rows predicted right next to the share of the commonest label, as one row.

    A model that always answers with the commonest label reaches the second
    number.
    """
    per_label = predictions.groupBy(label).agg(
        F.count("*").alias("_n"), F.count_if(F.col(prediction) == F.col(label)).alias("_right")
    )
    return per_label.agg(
        F.sum("_n").alias("n_rows"),
        F.sum("_right").alias("n_right"),
        (F.sum("_right") / F.sum("_n")).alias("accuracy"),
        (F.max("_n") / F.sum("_n")).alias("majority_share"),
    )


def confusion(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(label, prediction).agg(F.count("*").alias("n_rows"))


def evaluator_accuracy(predictions: DataFrame, label: str) -> float:
    """The evaluator's accuracy; rows without a prediction count as wrong, as in :func:`accuracy`."""
    return MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="accuracy"
    ).evaluate(predictions.fillna(-1.0, ["prediction"]))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
