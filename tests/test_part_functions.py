import math
import random

import pyarrow as pa
import pytest

from tallyloom.operators.part_functions import fold_parts, map_whole_parts
from tallyloom.plans.part_stats import longest_rise, spread_of_parts

SCHEMA = "part string, id bigint, v double"


@pytest.fixture(scope="module")
def data(spark):
    """One part holds 25,000 of 30,000 rows, in many batches and tasks; a null part; null values."""
    draw = random.Random(2)
    made = [("hot" if i % 6 else draw.choice(["a", "b", None]), i, None if i % 13 == 0 else float(draw.randrange(1000))) for i in range(30_000)]
    return spark.createDataFrame(made, SCHEMA).repartition(7).persist(), made


def of_parts(made):
    parts = {}
    for part, i, v in made:
        parts.setdefault(part, []).append((i, v))
    return {p: [v for _, v in sorted(rows)] for p, rows in parts.items()}


def test_one_call_per_part_in_order(data):
    frame, made = data

    def calls(part, batches):
        ids = [i for b in batches for i in b.column("id").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([len(ids)]), pa.array([ids == sorted(ids)])], names=["part", "n", "sorted"])

    found = map_whole_parts(frame, "part", calls, "part string, n bigint, sorted boolean", ["id"]).collect()
    assert {r["part"]: r["n"] for r in found} == {p: len(v) for p, v in of_parts(made).items()}
    assert len(found) == 4 and all(r["sorted"] for r in found)


def test_a_part_is_streamed(spark, data):
    """The 25,000 rows come in several batches, and the rows are shuffled and sorted once."""
    frame, _ = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def batches_of(part, batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in batches)])], names=["n"])

    found = map_whole_parts(frame, "part", batches_of, "n bigint", ["id"])
    assert max(r["n"] for r in found.collect()) >= 25
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    fresh = spark.range(100).selectExpr("id % 3 AS part", "id")
    plan = map_whole_parts(fresh, "part", batches_of, "n bigint", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_longest_rise(data):
    frame, made = data
    want = {}
    for part, values in of_parts(made).items():
        best = run = 0
        before = None
        for v in values:
            run = run + 1 if v is not None and before is not None and v > before else int(v is not None)
            before, best = v, max(best, run)
        want[part] = best
    assert {r["part"]: r["longest"] for r in longest_rise(frame, "part", ["id"], "v").collect()} == want


@pytest.mark.parametrize("held", [1, 10_000])
def test_spread(data, held):
    frame, made = data
    found = {r["part"]: r for r in spread_of_parts(frame, "part", "v", held=held).collect()}
    for part, values in of_parts(made).items():
        some = [v for v in values if v is not None]
        mean = sum(some) / len(some)
        r = found[part]
        assert (r["n_rows"], r["n_values"], r["low"], r["high"]) == (len(values), len(some), min(some), max(some))
        assert math.isclose(r["mean"], mean) and math.isclose(r["std"], math.sqrt(sum((v - mean) ** 2 for v in some) / len(some)))
    assert len(found) == 4


def test_states_are_merged_in_the_order_of_tasks(spark):
    frame = spark.range(0, 400, 1, 8).selectExpr("id % 2 AS part", "id")
    text = fold_parts(
        frame, "part", list, lambda s, b: [*s, *b.column("id").to_pylist()], lambda a, b: a + b,
        lambda s: {"ids": s}, "ids array<bigint>", held=1,
    )
    assert all(r["ids"] == sorted(r["ids"]) and len(r["ids"]) == 200 for r in text.collect())


def test_only_states_are_shuffled(data):
    plan = spread_of_parts(data[0], "part", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("RepartitionByExpression") < plan.index("MapInArrow")


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert longest_rise(empty, "part", ["id"], "v").count() == spread_of_parts(empty, "part", "v").count() == 0
    alone = spark.createDataFrame([("x", 1, None)], SCHEMA)
    assert longest_rise(alone, "part", ["id"], "v").first()["longest"] == 0
    assert tuple(spread_of_parts(alone, "part", "v").first()) == ("x", 1, 0, None, None, None, None)
