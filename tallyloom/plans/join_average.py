"""Join a large table with a dimension and average by the dimension's category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.joins import hash_join
from tallyloom.operators.topk import sort_descending


def category_average(large: DataFrame, dimension: DataFrame, key: str = "join_key", category: str = "category",
                     value: str = "data_value", name: str = "avg_val") -> DataFrame:
    """Mean of ``value`` per category, largest first.

    The large side is summed per key before the join, so a key with most of the
    rows travels as one row per task.
    """
    sums = large.groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    means = hash_join(sums, dimension, key).groupBy(category).agg(
        F.try_divide(F.sum("_s"), F.sum("_c")).alias(name)
    )
    return sort_descending(means, name)


def category_average_of_rows(large: DataFrame, dimension: DataFrame, key: str = "join_key", category: str = "category",
                             value: str = "data_value", name: str = "avg_val") -> DataFrame:
    """The same result from the joined rows."""
    joined = hash_join(large, dimension, key)
    return sort_descending(joined.groupBy(category).agg(F.avg(value).alias(name)), name)
