import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.factorised import Side, joined_pivot

CATEGORIES = ["a", "b", "unseen"]


@pytest.fixture(scope="module")
def tables(spark):
    """Five different tables; one key has many rows in each, some are missing somewhere, nulls throughout."""
    draw = random.Random(8)

    def key(spread):
        return None if draw.random() < 0.05 else draw.choice([1] * 4 + list(range(spread)))

    def maybe(v):
        return None if draw.random() < 0.1 else v

    first = spark.createDataFrame([(key(9), maybe(draw.choice("abc")), maybe(float(draw.randrange(50)))) for _ in range(60)], "id int, kind string, v double")
    second = spark.createDataFrame([(maybe(float(draw.randrange(9))), key(8)) for _ in range(25)], "w double, ref int")
    third = spark.createDataFrame([(key(7), draw.choice("xy")) for _ in range(20)], "k bigint, other string")
    fourth = spark.createDataFrame([(key(12),) for _ in range(15)], "id int")
    fifth = spark.createDataFrame([(n, n) for n in range(6)], "key int, id int")
    return [Side(first, "id"), Side(second, "ref"), Side(third, "k"), Side(fourth, "id"), Side(fifth, "key")]


def joined(sides):
    """All joined rows."""
    whole = None
    for n, s in enumerate(sides):
        t = s.table.select(F.col(s.key).cast("bigint").alias("key"), *[F.col(c).alias(f"{c}_{n}") for c in s.table.columns if c != s.key])
        whole = t if whole is None else whole.join(t, "key")
    return whole.persist()


@pytest.mark.parametrize("value", [(0, "v"), (1, "w")])
@pytest.mark.parametrize("stat", ["mean", "sum"])
def test_equals_the_pivot_of_the_joined_rows(tables, value, stat):
    rows = joined(tables)
    column = f"{value[1]}_{value[0]}"
    how = F.avg(column) if stat == "mean" else F.sum(column)
    want = {r["key"]: r for r in rows.groupBy("key").pivot("kind_0", CATEGORIES).agg(how).collect()}
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}
    found = joined_pivot(tables, (0, "kind"), value, CATEGORIES, stat, "key", "n_rows").collect()
    assert {r["key"] for r in found} == set(want) and len(found) == len(want) and max(counts.values()) > 4_000
    for r in found:
        assert r["n_rows"] == counts[r["key"]]
        for c in CATEGORIES:
            mine, theirs = r[c], want[r["key"]][c]
            assert mine == theirs or math.isclose(mine, theirs), (r["key"], c)


def test_no_joined_rows(spark, tables):
    """Every table is shuffled once, before the joins; the joins have one row per key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined_pivot(tables, (0, "kind"), (1, "w"), CATEGORIES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 4 and plan.count("HashAggregate") == 10
    assert plan.count("Exchange hashpartitioning") <= 5 + 2  # two tables have keys of another type


def test_a_key_with_more_rows_than_could_be_joined(spark):
    crowd = [Side(spark.range(20_000).selectExpr("1 AS id", "'a' AS kind", "CAST(id AS double) AS v"), "id") for _ in range(5)]
    means = joined_pivot(crowd, (0, "kind"), (0, "v"), ["a"]).collect()
    assert [r["a"] for r in means] == [9999.5]
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW|overflow"):
        joined_pivot(crowd, (0, "kind"), (0, "v"), ["a"], count="n").collect()


def test_empty_and_wrong(spark, tables):
    empty = Side(tables[1].table.limit(0), "ref")
    assert joined_pivot([tables[0], empty], (0, "kind"), (0, "v"), CATEGORIES).count() == 0
    with pytest.raises(ValueError):
        joined_pivot(tables, (0, "kind"), (0, "v"), CATEGORIES, "median")
