"""Joins, pivots, parts and row replication on the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators.aggregates import categories_of, column_stats, group_mean, group_stats, pivot_mean, sum_of_product
from tallyloom.operators.factorised import Side, joined_pivot
from tallyloom.operators.partitions import map_part_rows, part_counts, part_head, part_means, replicate_rows, total_rows, union_parts, union_totals
from tallyloom.plans import join_average, part_stats, wide_pivot
from tallyloom.sources.datagen import category_dimension
from tallyloom.workload.registry import query, table

# The categories that the SQL names; the queries take them from the data.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
RETURN_FLAGS = ["A", "N", "R"]

_CATEGORY_AVERAGE = """
SELECT 'Category_' || r.range AS category, round(avg(l_quantity), 6) AS avg_val
FROM lineitem JOIN range(1000) r ON l_orderkey % 1000 = r.range GROUP BY 1"""


def _join_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    large = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 1000).alias("join_key"), F.col("l_quantity").alias("data_value")
    )
    return large, category_dimension(spark, 1000)


@query(_CATEGORY_AVERAGE)
def hash_join_avg(spark: SparkSession, sf: str) -> DataFrame:
    return join_average.category_average(*_join_sides(spark, sf)).withColumn("avg_val", F.round("avg_val", 6))


@query(_CATEGORY_AVERAGE)
def hash_join_avg_rows(spark: SparkSession, sf: str) -> DataFrame:
    return join_average.category_average_of_rows(*_join_sides(spark, sf)).withColumn("avg_val", F.round("avg_val", 6))


@query(
    """SELECT a.c_custkey, a.c_nationkey AS c_nationkey_left2, a.c_acctbal AS c_acctbal_left2, b.c_nationkey AS c_nationkey_right2,
              b.c_acctbal AS c_acctbal_right2, c.c_nationkey AS c_nationkey_left4, c.c_acctbal AS c_acctbal_left4,
              d.c_nationkey AS c_nationkey_right4, d.c_acctbal AS c_acctbal_right4, e.c_nationkey, e.c_acctbal
       FROM customer a JOIN customer b USING (c_custkey) JOIN customer c USING (c_custkey) JOIN customer d USING (c_custkey)
       JOIN customer e USING (c_custkey)"""
)
def suffix_multijoin(spark: SparkSession, sf: str) -> DataFrame:
    slim = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return wide_pivot.joined_rows([slim] * 5, on="c_custkey")


# Five different tables joined on one number: users, customers (twice) and parts (twice).
_FIVE = """FROM events JOIN orders ON o_custkey = user_id JOIN customer ON c_custkey = user_id
  JOIN part ON p_partkey = user_id JOIN lineitem ON l_partkey = user_id GROUP BY user_id"""


def _five(spark: SparkSession, sf: str) -> list[Side]:
    keys = {"events": "user_id", "orders": "o_custkey", "customer": "c_custkey", "part": "p_partkey", "lineitem": "l_partkey"}
    return [Side(table(spark, sf, name), key) for name, key in keys.items()]


_FILTERED = ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in EVENT_TYPES)


@query(f"SELECT user_id, {_FILTERED} {_FIVE}")
def join_pivot_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Five tables joined, then the mean of the first one's value per key and category."""
    sides = _five(spark, sf)
    types = categories_of(sides[0].table, "event_type")
    means = joined_pivot(sides, (0, "event_type"), (0, "value"), types, "mean", "user_id")
    return means.select("user_id", *[F.round(t, 6).alias(t) for t in types])


_TOTALS = ", ".join(f"sum(l_quantity) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)


@query(f"SELECT user_id, count(*) AS n_rows, {_TOTALS} {_FIVE}")
def join_pivot_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The same join with the category of one table and the value of another, and the number of joined rows."""
    sides = _five(spark, sf)
    types = categories_of(sides[0].table, "event_type")
    return joined_pivot(sides, (0, "event_type"), (4, "l_quantity"), types, "sum", "user_id", "n_rows")


@query(
    "SELECT l_suppkey, "
    + ", ".join(f"round(avg(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 6) AS flag_{f}" for f in RETURN_FLAGS)
    + " FROM lineitem GROUP BY l_suppkey"
)
def pivot_mean_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    flags = categories_of(items, "l_returnflag")
    means = pivot_mean(items, "l_suppkey", "l_returnflag", "l_quantity", flags)
    return means.select("l_suppkey", *[F.round(f, 6).alias(f"flag_{f}") for f in flags])


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("part_id", F.col("event_id") % 4)


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def groupby_mean(spark: SparkSession, sf: str) -> DataFrame:
    return group_mean(table(spark, sf, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_id % 4 AS part_id, event_type, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def part_means_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return part_means(_parts(spark, sf), "part_id", "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_id % 4 AS part_id, count(*) AS n_rows FROM events GROUP BY 1")
def part_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return part_counts(_parts(spark, sf), "part_id")


@query("SELECT count(*) AS n_rows FROM events")
def part_row_total(spark: SparkSession, sf: str) -> DataFrame:
    return total_rows(part_counts(_parts(spark, sf), "part_id"))


@query(
    """SELECT part_id, event_id, user_id, value FROM (
         SELECT event_id % 4 AS part_id, event_id, user_id, value, row_number() OVER (PARTITION BY event_id % 4 ORDER BY value DESC, event_id) AS r FROM events)
       WHERE r <= 5"""
)
def part_head_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf).select("part_id", "event_id", "user_id", "value")
    return part_head(rows, "part_id", [F.desc("value"), "event_id"], 5)


@query("SELECT event_id, value, round(value * value + 1, 4) AS shifted FROM events")
def part_map(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "value")
    return map_part_rows(
        events, lambda pdf: pdf.assign(shifted=(pdf["value"] ** 2 + 1).round(4)), "event_id bigint, value double, shifted double"
    )


@query(
    """WITH o AS (SELECT event_id % 4 AS part_id, event_id, value, lag(value) OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS before FROM events),
       g AS (SELECT part_id, value, sum(CASE WHEN value > before THEN 0 ELSE 1 END) OVER (PARTITION BY part_id ORDER BY event_id) AS rise FROM o)
       SELECT part_id, max(n) AS longest FROM (SELECT part_id, rise, count(value) AS n FROM g GROUP BY ALL) GROUP BY part_id"""
)
def part_longest_rise(spark: SparkSession, sf: str) -> DataFrame:
    """A function of the rows of a whole part in their order."""
    return part_stats.longest_rise(_parts(spark, sf), "part_id", ["event_id"], "value")


@query(
    """SELECT event_id % 4 AS part_id, count(*) AS n_rows, count(value) AS n_values, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
              min(value) AS low, max(value) AS high FROM events GROUP BY 1"""
)
def part_spread(spark: SparkSession, sf: str) -> DataFrame:
    """A function of a whole part that is folded in pieces."""
    found = part_stats.spread_of_parts(_parts(spark, sf), "part_id", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT event_type, count(*) AS n_rows, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def union_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "value")
    parts = [F.col("event_type").eqNullSafe(F.lit(t)) for t in [*categories_of(events, "event_type"), None]]
    whole = union_parts([events.where(part) for part in parts])
    return whole.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


_OVERLAPPING = {"high": "value > 50", "even": "event_id % 2 = 0", "typed": "event_type IS NOT NULL"}


@query(
    "SELECT part, event_type, count(*) AS n_rows, round(sum(value), 2) AS value FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS part, event_type, value FROM events WHERE {test}" for name, test in _OVERLAPPING.items())
    + ") GROUP BY ALL"
)
def union_of_overlapping_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over the union of three overlapping parts, in one scan."""
    parts = {name: F.expr(test) for name, test in _OVERLAPPING.items()}
    return union_totals(table(spark, sf, "events"), parts, ["event_type"], ["value"]).withColumn("value", F.round("value", 2))


@query("SELECT event_type, count(*) * 10 AS n_rows, round(sum(value) * 10, 2) AS total FROM events GROUP BY event_type")
def replicated_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = replicate_rows(table(spark, sf, "events").select("event_type", "value"), 10)
    return rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem")
def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    stats = column_stats(table(spark, sf, "lineitem"), "l_quantity")
    return stats.select(F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n_rows, sum(l_quantity * l_linenumber) AS weighted, round(avg(l_quantity), 6) AS mean,
              round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY ALL"""
)
def grouped_stats(spark: SparkSession, sf: str) -> DataFrame:
    return group_stats(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
        n_rows=F.count("*"), weighted=sum_of_product("l_quantity", "l_linenumber"),
        mean=F.round(F.avg("l_quantity"), 6), std=F.round(F.stddev_samp("l_quantity"), 6),
    )
