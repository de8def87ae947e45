import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars
from tallyloom.operators import model as ops
from tallyloom.plans import classifier, fraud
from tallyloom.sources import datagen


@pytest.fixture(scope="module")
def banking(spark):
    return datagen.banking(spark.range(4000)).withColumn("row", F.monotonically_increasing_id()).persist()


def test_split_is_repeatable(spark):
    a, b = ops.hash_split(spark.range(5000), ["id"])
    c, d = ops.hash_split(spark.range(5000).repartition(7), ["id"])
    assert a.count() + b.count() == 5000 and a.intersect(b).isEmpty()
    assert a.exceptAll(c).isEmpty() and b.exceptAll(d).isEmpty()
    assert 0.77 < a.count() / 5000 < 0.83


def test_forest(banking, tmp_path):
    trained = classifier.train_and_score(banking, ["row"], trees=5, depth=3)
    assert not {"probability", "rawPrediction", "features"} & set(trained.predictions.columns)
    scores = trained.scores.first()
    assert abs(scores["accuracy"] - ops.evaluator_accuracy(trained.predictions, "fraud_trx")) < 1e-12
    # The label does not depend on the features: the majority share is the best there is.
    assert 0.8 < scores["majority_share"] <= 1 and abs(scores["accuracy"] - scores["majority_share"]) < 0.05
    ops.save_model(trained.model, str(tmp_path / "m"))
    again = ops.predict(ops.load_model(str(tmp_path / "m")), trained.predictions.withColumnRenamed("prediction", "first"))
    assert again.where("first <> prediction").isEmpty()
    scored = classifier.score_scaled(trained.model, banking, datagen.BANKING_FEATURES, times=3)
    assert scored.count() == 12000 and "fraud_trx" not in scored.columns


def test_forest_learns_what_can_be_learned(spark):
    df = spark.range(3000).select("id", scalars.uniform("id", 1).alias("x"), scalars.uniform("id", 2).alias("y"))
    df = df.withColumn("label", (F.col("x") > 0.5).cast("int"))
    trained = classifier.train_and_score(df, ["id"], ["x", "y"], "label", trees=5)
    assert trained.scores.first()["accuracy"] > 0.97
    assert sum(r["n_rows"] for r in ops.confusion(trained.predictions, "label").collect()) == trained.predictions.count()


def test_banking_schema_and_ranges(banking):
    types = dict(banking.dtypes)
    assert [types[c] for c in datagen.BANKING_FEATURES] == ["float"] * 14 and types["fraud_trx"] == "int"
    low_high = banking.agg(*[F.min(c).alias(f"a_{c}") for c in datagen.BANKING_FEATURES], *[F.max(c).alias(f"b_{c}") for c in datagen.BANKING_FEATURES]).first()
    for name, (low, high) in datagen.BANKING_RANGES.items():
        assert low - 1e-6 <= low_high[f"a_{name}"] and low_high[f"b_{name}"] <= high
    assert 0.07 < banking.agg(F.avg("fraud_trx")).first()[0] < 0.13
    assert banking.select("age").distinct().count() <= 91
    assert fraud.banking_summary(banking).count() == 2


def test_values_do_not_depend_on_partitions(spark):
    a = datagen.banking(spark.range(300, numPartitions=2))
    b = datagen.banking(spark.range(300, numPartitions=9))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_wide_table(spark):
    wide = datagen.wide(spark.range(10), columns=10_000)
    assert len(wide.columns) == 10_000 and wide.columns[:3] == ["unique_id", "col1", "col2"] and wide.columns[-1] == "col9999"
    narrow = datagen.wide(spark.range(2000), columns=4, id_range=100)
    assert narrow.select("unique_id").distinct().count() == 100
    assert [r[0] for r in narrow.select("col1").limit(16).collect()] == [*datagen.WIDE_CATEGORIES, "A"]


def test_wide_cells_are_the_cells_of_the_wide_table(spark):
    base = spark.createDataFrame([(0,), (-7,), (2**40 + 3,), (2**63 - 1,), (-(2**63),), (None,)], "id bigint")
    wide = datagen.wide(base, columns=30)
    sums = {r["column_number"]: (r["n_rows"], r["total"]) for r in datagen.column_sums(datagen.wide_cells(base, columns=30, tasks=3)).collect()}
    whole = wide.agg(*[F.sum(f"col{i}").alias(f"col{i}") for i in range(2, 30)]).first()
    assert sums == {i: (5, whole[f"col{i}"]) for i in range(2, 30)}
    assert datagen.column_sums(datagen.wide_cells(base.limit(0), columns=30)).isEmpty()


def test_hashed_values_are_spread_evenly(spark):
    u = spark.range(20_000).select(*[scalars.uniform("id", s).alias(f"u{s}") for s in (1, 2, 3, 100)]).toPandas()
    assert u.min().min() >= 0 and u.max().max() < 1
    assert abs(u.mean() - 0.5).max() < 0.01 and abs(u.std() - 12**-0.5).max() < 0.01
    assert (abs(u.corr()) - (u.corr() == 1)).max().max() < 0.03
    assert abs(u["u1"].corr(u["u1"].shift(1))) < 0.03


def test_retail_tables(spark):
    made = datagen.retail_tables(spark, scale=0.01, products=500)
    counts = {n: df.count() for n, df in made.items()}
    assert counts == {"sales": 10_000, "stock": 500, "supplier": 500, "customer": 10, "market": 5_000, "logistic": 5_000}
    assert made["sales"].select("product_name").distinct().count() == 500
    from tallyloom.plans import retail
    for name, df in made.items():
        assert [f.split()[0] for f in retail.SCHEMAS[name].split(", ")] == df.columns
    joined = retail.clean_and_join(made)
    assert joined.count() == 10_000
    # Customer numbers go far beyond the customers there are.
    assert joined.where("customer_name is null").count() > 9_900


def test_key_values_repeat_in_every_part(spark):
    kv = datagen.key_values(spark.range(3000), parts=2)
    assert kv.where("part_id = 0").drop("part_id").exceptAll(kv.where("part_id = 1").drop("part_id")).isEmpty()
    s = kv.agg(F.avg("key").alias("k"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    assert abs(s["k"] - 0.5) < 0.05 and abs(s["m"]) < 0.08 and abs(s["s"] - 1) < 0.08


def test_scalars(spark, rows):
    df = spark.createDataFrame([(1.0, "2022-3-7"), (30.0, "2022-11-28"), (None, "bad")], "x double, d string")
    label = scalars.bucketise("x", [30, 45], ["a", "b", "c"])
    assert [r[0] for r in df.select(label).collect()] == ["a", "b", "c"]
    assert [str(r[0]) for r in df.select(scalars.day("d", strict=False)).collect()] == ["2022-03-07", "2022-11-28", "None"]
    with pytest.raises(Exception):
        df.select(scalars.day("d")).collect()
    with pytest.raises(ValueError):
        scalars.bucketise("x", [1], ["a"])


def test_rows_with_a_missing_feature_are_kept_when_scoring(spark):
    rows = [(i, float(i % 7) if i % 4 else None, float("nan") if i % 10 == 1 else 1.0, int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    model = ops.fit_forest(df, ["a", "b"], "y", trees=3, depth=3)
    scored = ops.predict(model, df)
    assert {r["id"] for r in scored.where("prediction is null").collect()} == {i for i, a, b, _ in rows if a is None or b != b}
    measured = ops.accuracy(scored, "y").first()
    assert measured["n_rows"] == 200 and abs(measured["accuracy"] - ops.evaluator_accuracy(scored, "y")) < 1e-12
    assert classifier.score_scaled(model, df, ["a", "b"], times=3).count() == 600
    nodes = ops.forest_nodes(model)
    again = ops.predict_by_nodes(nodes, scored.withColumnRenamed("prediction", "first"), ["a", "b"])
    assert again.count() == 200 and again.where("not first <=> prediction").isEmpty()
    leaves, inner = (nodes.where(f"feature is {kind}").count() for kind in ("null", "not null"))
    assert leaves == inner + 3 and nodes.groupBy("tree", "node").count().where("count > 1").isEmpty()
    with_odd_name = again.select("id", F.col("a"), F.col("b"), F.lit(1).alias("x.y"))
    assert ops.predict_by_nodes(nodes, with_odd_name.limit(0)).columns == ["id", "a", "b", "x.y", "prediction"]
