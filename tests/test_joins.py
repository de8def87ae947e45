import random

import pytest
from pyspark.sql import functions as F

from tallyloom import scratch
from tallyloom.functions.scalars import bucketise
from tallyloom.operators import aggregates, joins, partitions
from tallyloom.operators.aggregates import categories_of
from tallyloom.operators.windows import running_average
from tallyloom.plans import join_average, part_stats, wide_pivot
from tallyloom.sinks.writers import plan_text
from tallyloom.sources import datagen


def test_left_chain_with_repeated_and_null_keys(spark, rows):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z"), (5, "a")], "id int, k string")
    one = spark.createDataFrame([("a", 1), ("a", 2), (None, 9), ("q", 7)], "k string, one int")
    two = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21), (None, 90), ("r", 70)], "k string, two int")
    three = spark.createDataFrame([("b", 5)], "k string, three int")
    plain = fact.join(one, "k", "left").join(two, "k", "left").join(three, "k", "left")
    ours = joins.left_join_chain(fact, [(one, "k"), (two, "k"), (three, "k")])
    assert ours.columns == plain.columns
    assert rows(ours) == rows(plain)
    assert rows(joins.repeated_keys(one, "k")) == [("a", 2)]


def test_large_side_meets_each_key_once(spark):
    fact = spark.range(1000).withColumn("k", F.col("id") % 7)
    dims = [spark.range(7).select(F.col("id").alias("k"), F.lit(i).alias(f"d{i}")) for i in range(4)]
    chain = joins.left_join_chain(fact, [(d, "k") for d in dims])
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 1 and "FullOuter" not in plan
    assert "BroadcastHashJoin" in plan_text(chain)


def test_suffixes_only_where_names_collide(spark):
    slim = spark.createDataFrame([("ID1", "A", 1.0), ("ID2", "B", 2.0)], "unique_id string, col1 string, col2 double")
    t = slim
    after_two = joins.suffix_join_all([t, t], "unique_id").columns
    assert after_two == ["unique_id", "col1_left2", "col2_left2", "col1_right2", "col2_right2"]
    assert joins.suffix_join_all([t] * 3, "unique_id").columns == [*after_two, "col1", "col2"]
    after_four = joins.suffix_join_all([t] * 4, "unique_id").columns
    assert after_four == [*after_two, "col1_left4", "col2_left4", "col1_right4", "col2_right4"]
    five = joins.suffix_join_all([t] * 5, "unique_id")
    assert five.columns == [*after_four, "col1", "col2"]
    assert five.count() == 2


def test_pivot_without_the_joined_rows(spark):
    rng = random.Random(1)
    made = [(f"ID{rng.randrange(15)}", "ABCDEFGHIJKLMNO"[i % 15], float(rng.randrange(100))) for i in range(40)]
    t = spark.createDataFrame(made, "unique_id string, col1 string, col2 double")
    # The other tables differ from the first one: other counts, and one key missing.
    other = t.where("unique_id <> 'ID3'").unionByName(t.limit(10))
    tables = [t, t, other]
    want = {r["unique_id"]: r.asDict() for r in wide_pivot.pivot_of_joined_rows(tables).collect()}
    got = {r["unique_id"]: r.asDict() for r in wide_pivot.join_pivot(tables).collect()}
    assert got.keys() == want.keys()
    for key in want:
        for c in datagen.WIDE_CATEGORIES:
            assert got[key][c] == want[key][c] or abs(got[key][c] - want[key][c]) < 1e-9


def test_wide_pivot_reads_three_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    datagen.wide(spark.range(50), columns=60, id_range=20).write.parquet(path)
    wide = spark.read.parquet(path)
    assert len(wide.columns) == 60
    plan = plan_text(wide_pivot.join_pivot([wide] * 5))
    schemas = {line.strip() for line in plan.splitlines() if "ReadSchema" in line}
    assert "ReadSchema: struct<unique_id:string,col1:string,col2:float>" in schemas
    assert schemas <= {"ReadSchema: struct<unique_id:string,col1:string,col2:float>", "ReadSchema: struct<unique_id:string>"}
    wide_pivot.run([wide] * 2, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["unique_id", *datagen.WIDE_CATEGORIES]


def test_derived_dimension(spark, rows):
    df = spark.createDataFrame([(1, 10.0), (2, 40.0), (3, None), (4, 10.0)], "id int, age double")
    label = bucketise("age", [30, 60], ["low", "mid", "high"])
    assert rows(joins.derived_dimension(df, "age", label, "b")) == [(10.0, "low"), (40.0, "mid"), (None, "high")]
    joined = joins.join_derived_dimension(df, "age", label, "b")
    assert rows(joined, "id", "b") == [(1, "low"), (2, "mid"), (4, "low")]
    assert rows(joined, "id", "b") == rows(joins.with_derived_label(df, "age", label, "b"), "id", "b")
    assert "BroadcastHashJoin" in plan_text(joined)


def test_hash_hint_builds_on_the_small_side(spark):
    large, small = datagen.join_inputs(spark, 5000, 50)
    plan = plan_text(joins.hash_join(large, small, "join_key"))
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "CartesianProduct" not in plan


def test_category_average_both_ways(spark):
    large, small = datagen.join_inputs(spark, 5000, 50)
    a = {r[0]: r[1] for r in join_average.category_average(large, small).collect()}
    b = {r[0]: r[1] for r in join_average.category_average_of_rows(large, small).collect()}
    assert len(a) == 50 and a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_pivot_columns_do_not_depend_on_the_data(spark, rows):
    df = spark.createDataFrame([(1, "A", 2.0), (1, "A", 4.0), (2, "B", 6.0), (2, "X", 6.0)], "k int, c string, v double")
    out = aggregates.pivot_mean(df, "k", "c", "v", ["A", "B", "C"])
    assert out.columns == ["k", "A", "B", "C"]
    assert rows(out) == [(1, 3.0, None, None), (2, None, 6.0, None)]


def test_parts(spark, rows):
    df = datagen.key_values(spark.range(400))
    report = part_stats.part_report(df)
    assert rows(report["counts"]) == [(0, 400), (1, 400)] and rows(report["total"]) == [(800,)]
    per_part = {(r[0], r[1]): r[2] for r in report["part_means"].collect()}
    for r in report["means"].collect():
        # The parts are copies, so each has the mean of the whole.
        assert abs(per_part[(0, r["key"])] - r["mean"]) < 1e-9 and abs(per_part[(1, r["key"])] - r["mean"]) < 1e-9
    assert report["head"].groupBy("part_id").count().where("count <> 5").isEmpty()


def test_part_head_keeps_few_rows_per_task(spark):
    df = spark.range(1000).withColumn("part_id", F.col("id") % 2)
    head = partitions.part_head(df, "part_id", [F.desc("id")], 3)
    assert [r["id"] for r in head.orderBy(F.desc("id")).collect()] == [999, 998, 997, 996, 995, 994]
    assert "WindowGroupLimit" in plan_text(head, "simple") and "Partial" in plan_text(head, "simple")


def test_keyed_tables_share_one_layout(spark, small_partitions):
    left = partitions.keyed(_hot(spark), "k", partitions=6)
    joined = left.join(partitions.keyed(_hot(spark).select("k").distinct(), "k", partitions=6), "k")
    assert "k" in joined.columns and joined.count() == 120_000
    again = left.groupBy("k").count()
    assert plan_text(again, "simple").count("Exchange") == 1


def test_replication_does_not_shuffle(spark, rows):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    out = partitions.replicate_rows(df, 3)
    assert out.columns == ["v"] and rows(out) == [(1,)] * 3 + [(2,)] * 3
    assert "Exchange" not in plan_text(out)
    assert rows(partitions.replicate_rows(df, 2, "n")) == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.fixture
def small_partitions(spark):
    """Settings under which the test tables count as large and skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _hot(spark):
    """120,000 rows, a third of them under one key."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000)
    load = F.xxhash64("id").alias("load")
    return spark.range(0, 120_000, 1, 8).select("id", k.alias("k"), (F.col("id") % 50).alias("d"), F.lit(1.0).alias("v"), load)


def _final_plan(df):
    df.collect()
    return plan_text(df, "simple").split("== Initial Plan ==")[0]


def test_hot_keys_of_a_join_chain_are_split(spark, small_partitions):
    dims = [(spark.range(1000).select(F.col("id").alias("k"), F.lit(i).alias(f"d{i}")), "k") for i in range(2)]
    out = joins.left_join_chain(_hot(spark), dims).agg(F.count("*").alias("n"), F.sum("d1"), F.max("load"))
    plan = _final_plan(out)
    assert out.first()["n"] == 120_000
    assert "skew=true" in plan.lower(), plan


def test_hot_keys_of_a_running_average_are_split(spark, small_partitions):
    rows = _hot(spark).withColumn("d", F.when(F.col("k") == 0, 7).otherwise(F.col("d")))
    out = running_average(rows, ["k"], "d", "v").agg(F.count("*").alias("n"), F.sum("running_avg").alias("s"), F.max("load").alias("m"))
    plan = _final_plan(out)
    assert out.first()["n"] == 120_000 and out.first()["s"] == 120_000.0
    assert "skew=true" in plan.lower(), plan


def test_hot_keys_of_a_self_join_chain_are_split(spark, small_partitions):
    hot = _hot(spark).select("k", "load")
    one = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    out = joins.suffix_join_all([hot, one, one], "k").agg(F.count("*").alias("n"), F.max("load"))
    plan = _final_plan(out)
    assert out.first()["n"] == 120_000
    assert "skew=true" in plan.lower(), plan


def test_chain_stores_no_product_of_keys_the_fact_lacks(spark, monkeypatch):
    sizes = []

    def counted(df, label):
        stored = scratch.materialise(df, label)
        if label == "combined":
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(joins, "materialise", counted)
    fact = spark.createDataFrame([(1, "f"), (None, "n")], "k int, v string")
    one = spark.createDataFrame([(1, 5), (1, 6)] + [(9, i) for i in range(50)], "k int, a int")
    two = spark.createDataFrame([(1, 7)] + [(9, i) for i in range(50)], "k int, b int")
    got = joins.left_join_chain(fact, [(one, "k"), (two, "k")]).collect()
    assert sorted(map(str, got)) == sorted(map(str, joins.left_join(joins.left_join(fact, one, "k"), two, "k").collect()))
    assert sizes == [2] and len(got) == 3


def test_categories_are_all_found_or_refused(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    assert categories_of(df, "c") == ["a", "b"]
    with pytest.raises(ValueError):
        categories_of(df, "c", most=1)


def test_chain_joins_narrow_tables_first_and_keeps_the_columns(spark, rows):
    """The wide table's columns are not shuffled for the narrow table's key; repeated and missing keys count as in the plain chain."""
    fact = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 10, "z"), (None, None, "n")], "a int, b int, f string")
    wide = spark.createDataFrame([(1, "p", "q", "r"), (1, "p2", "q2", "r2"), (3, "u", "v", "w")], "a int, w1 string, w2 string, w3 string")
    narrow = spark.createDataFrame([(10, 0.5), (10, 0.25)], "b int, n double")
    plain = fact.join(wide, "a", "left").join(narrow, "b", "left")
    chained = joins.left_join_chain(fact, [(wide, "a"), (narrow, "b")])
    assert chained.columns == plain.columns and rows(chained) == rows(plain)
    outermost = next(line for line in chained._jdf.queryExecution().analyzed().toString().splitlines() if "Join LeftOuter" in line)
    assert "a#" in outermost and "b#" not in outermost


def test_chain_keeps_the_order_where_a_key_comes_from_a_table(spark, rows):
    fact = spark.createDataFrame([(1, "x"), (2, "y")], "a int, f string")
    bridge = spark.createDataFrame([(1, 7, "p", "q")], "a int, b int, w1 string, w2 string")
    last = spark.createDataFrame([(7, 0.5)], "b int, n double")
    assert rows(joins.left_join_chain(fact, [(bridge, "a"), (last, "b")])) == rows(fact.join(bridge, "a", "left").join(last, "b", "left"))
