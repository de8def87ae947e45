"""Grouped aggregation, pivots and tables of statistics.

Each of these is an aggregation Spark splits into a partial and a final step,
so what is shuffled for a key is at most one row per input partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.scalars import as_column


def group_stats(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])


def group_by_dict(df: DataFrame, keys: Sequence[str], spec: Mapping[str, str]) -> DataFrame:
    """``{"price": "avg"}`` style aggregation; columns are named ``avg(price)``."""
    return df.groupBy(*keys).agg(dict(spec))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def sum_of_product(a: Column | str, b: Column | str) -> Column:
    return F.sum(as_column(a) * as_column(b))


def categories_of(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct values of a column in order, without null; more than ``most`` raise, so that none is left out."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r[0] for r in found)


def pivot_mean(df: DataFrame, index: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """One row per index, one mean per category.

    The categories are given, so the output columns do not depend on the data;
    :func:`categories_of` finds those of a table.
    """
    return df.groupBy(index).pivot(category, list(categories)).agg(F.avg(value))


def self_join_pivot_mean(
    left: DataFrame, others: Sequence[DataFrame], index: str, category: str, value: str, categories: Sequence[str]
) -> DataFrame:
    """Pivot of means over ``left`` inner-joined with every other table on ``index``.

    The join repeats each left row of a key equally often, which leaves means
    alone, so testing that the key occurs in the other tables is enough: the
    product of the key's row counts never exists.
    """
    kept = left.select(index, category, value).where(F.col(index).isNotNull())
    for other in others:
        kept = kept.join(other.select(index), index, "left_semi")
    return pivot_mean(kept, index, category, value, categories)


def column_stats(df: DataFrame, value: str) -> DataFrame:
    """Sum, mean and population standard deviation of one column, as one row."""
    return df.agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
