import math
import random

import pytest
from pyspark.sql import Window, functions as F

from tallyloom.operators import windows
from tallyloom.operators.windows import _per_order_value, in_blocks, neighbour_totals, running_average, running_neighbours

SCHEMA = "id bigint, k string, d int, v double"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    made = []
    for i in range(600):
        # One key holds most rows, one day of it holds a third of all.
        k = None if i % 50 == 0 else "hot" if i % 5 else rng.choice("abc")
        d = None if i % 41 == 0 else 7 if i % 3 == 0 else rng.randrange(40)
        made.append((i, k, d, None if i % 11 == 0 else float(rng.randrange(100))))
    made += [(1000, "nulls", 1, None), (1001, "nulls", 2, None), (1002, "nulls", 3, 5.0)]
    return spark.createDataFrame(made, SCHEMA).repartition(4).persist()


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12))


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(params=[1, 23], ids=["one block", "blocks"])
def blocks(spark, request):
    """As many blocks as a range partitioning makes, not merged again."""
    settings = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_average(data, blocks):
    w = Window.partitionBy("k").orderBy("d")
    want = by_id(data.withColumn("x", F.avg("v").over(w)), "x")
    got = by_id(running_average(data, ["k"], "d", "v", "x"), "x")
    assert got.keys() == want.keys()
    assert all(same(got[i][0], want[i][0]) for i in want)


def test_neighbours(data, blocks):
    w, total = Window.partitionBy("k").orderBy("d"), Window.partitionBy("k").orderBy("d", "id")
    ra = data.withColumn("running_avg", F.avg("v").over(w))
    ra = ra.withColumns({"prev_avg": F.lag("running_avg").over(total), "next_avg": F.lead("running_avg").over(total)})
    names = ["running_avg", "prev_avg", "next_avg"]
    want, got = by_id(ra, *names), by_id(running_neighbours(data, ["k"], "d", "v", ["id"]), *names)
    assert got.keys() == want.keys()
    for i in want:
        assert all(same(a, b) for a, b in zip(got[i], want[i])), i

    sums = ra.groupBy("k").agg(F.sum("prev_avg").alias("p"), F.sum("next_avg").alias("n"))
    want = {r["k"]: (r["p"], r["n"]) for r in sums.collect()}
    got = {r["k"]: (r["p"], r["n"]) for r in neighbour_totals(data, ["k"], "d", "v", "p", "n").collect()}
    assert got.keys() == want.keys()
    assert all(same(a, b) for k in want for a, b in zip(got[k], want[k]))


def test_input_columns_and_row_count_are_kept(data):
    out = running_average(data, ["k"], "d", "v")
    assert out.columns == [*data.columns, "running_avg"]
    assert out.count() == data.count()


@pytest.mark.parametrize("unique", [True, False])
def test_repeated_ties_equal_a_window(spark, blocks, unique):
    """Rows that share the first column of the tie, all of it, or everything; nulls among them."""
    rng = random.Random(9)
    if unique:
        made = [(i, "ab"[i % 2], i % 9, float(rng.randrange(50)), i, 0) for i in range(200)]
    else:
        made = [(0, "ab"[i % 2], None if i % 23 == 0 else i % 5, float(rng.randrange(50)), None if i % 7 == 0 else rng.randrange(4), rng.choice([None, 1, 2])) for i in range(300)]
        made += [(0, "c", 1, 4.0, 1, 1)] * 40 + [(0, "c", 2, 6.0, None, None)] * 3 + [(0, "d", 1, None, 1, 1)] * 2
    frame = spark.createDataFrame(made, SCHEMA + ", t bigint, u bigint").repartition(3).persist()
    total = Window.partitionBy("k").orderBy("d", "t", "u")
    want = frame.withColumn("running_avg", F.avg("v").over(Window.partitionBy("k").orderBy("d")))
    want = want.withColumns({"prev_avg": F.lag("running_avg").over(total), "next_avg": F.lead("running_avg").over(total)})
    got = running_neighbours(frame, ["k"], "d", "v", ["t", "u"], unique_tie=unique)
    assert got.columns == want.columns

    def counted(df):
        # Which of the rows with one tie is the first is open, and with it the value that goes along.
        found = {}
        for r in df.collect():
            key = (r["k"], r["d"], r["t"], r["u"], *(None if r[c] is None else round(r[c], 9) for c in ("running_avg", "prev_avg", "next_avg")))
            found[key] = found.get(key, 0) + 1
        return found

    assert counted(got) == counted(want)


def test_one_hot_key_is_spread_over_blocks(spark, blocks):
    """A key with all rows: no block holds much more than its share of the order values."""
    frame = spark.range(5000).select(F.lit("hot").alias("k"), (F.col("id") % 2300).alias("d"), F.lit(1.0).alias("v"))
    sizes = [r["count"] for r in in_blocks(_per_order_value(frame, ["k"], "d", "v"), ["k"], "d").groupBy("_block").count().collect()]
    assert sum(sizes) == 2300 and len(sizes) >= 0.8 * blocks and max(sizes) <= 2.5 * 2300 / blocks
    last = running_average(frame, ["k"], "d", "d", "x").agg(F.max("x")).first()[0]
    assert math.isclose(last, frame.agg(F.avg("d")).first()[0])


def test_no_sort_aggregate(spark, data):
    plan = running_neighbours(data, ["k"], "d", "v", ["id"], unique_tie=True)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in _per_order_value(data, ["k"], "d", "v", F.col("id"))._jdf.queryExecution().toString()


def test_days_of_one_row_are_not_grouped_again(spark, rows, monkeypatch):
    """Only rows of (key, day) groups of several rows are shuffled to choose among them."""
    data = spark.createDataFrame(
        [("a", d, 10 * d, "t", i) for d in range(1, 6) for i in range(1 + (d == 3))], "k string, day int, v int, t string, u int"
    )
    looked_at, store = [], windows.materialise
    monkeypatch.setattr(windows, "materialise", lambda df, label: (label == "running-rows" and looked_at.append(df)) or store(df, label))
    found = windows.running_neighbours(data, ["k"], "day", "v", ["t", "u"])
    assert [r[0] for r in rows(looked_at[0].where("_several"), "day")] == [3, 3]
    by_hand = Window.partitionBy("k").orderBy("day")
    want = data.withColumn("ra", F.avg("v").over(by_hand))
    w = Window.partitionBy("k").orderBy("day", "t", "u")
    want = want.select("day", "u", "ra", F.lag("ra").over(w).alias("p"), F.lead("ra").over(w).alias("n"))
    assert rows(found, "day", "u", "running_avg", "prev_avg", "next_avg") == rows(want)


def test_totals_carry_only_the_sums_windows_need(spark, data, rows, monkeypatch):
    """The sums per order value are stored before they are cut into blocks; further sums stay out of the blocks."""
    stored, store = {}, windows.materialise
    monkeypatch.setattr(windows, "materialise", lambda df, label: stored.setdefault(label, df) and store(df, label))
    got = neighbour_totals(data, ["k"], "d", "v", sums={"ids": F.col("id")})
    assert got.columns == ["k", "ids", "total_prev", "total_next"]
    assert rows(got, "k", "ids") == rows(data.groupBy("k").agg(F.sum("id").alias("ids")))
    assert "ids" in stored["order-sums"].columns and "ids" not in stored["running-sums"].columns
