"""Pivots over a join of many tables whose rows are never made.

A key with n1, n2, ... rows in the joined tables has n1 * n2 * ... joined rows.
Sums and counts over them factor: every table is summed per key on its own, and
the sums are multiplied along the join. Each table is shuffled once, as one row
per key and task; the joins then meet rows that are laid out by the key
already, one per key and table, so a key with very many rows is no hot task.

Means never need the product. Sums and row counts are exact; a row count
beyond 64 bits raises, as the joined rows could not be counted either.

Defined results: a null key joins nothing; a key that one table lacks has no
row; rows with a null category count as joined rows and are in no column; null
values are in no mean and no sum; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Side:
    """A table of the join and the column it is joined on."""

    table: DataFrame
    key: str


def _per_category(categories: Sequence, column: str, total: Column, name: str) -> list[Column]:
    return [F.sum(F.when(F.col(column) == F.lit(c), total)).alias(f"{name}{i}") for i, c in enumerate(categories)]


def _factor(side: Side, n: int, category: str | None, value: str | None, categories: Sequence) -> DataFrame:
    """One row per key: rows, values and their sum, in all and per category."""
    columns = [F.col(side.key).alias("_key")]
    columns += [F.col(category).alias("_category")] if category else []
    columns += [F.col(value).alias("_value")] if value else []
    rows = side.table.select(*columns).where("_key is not null")
    found = [F.count(F.lit(1)).alias(f"_n{n}")]
    one = F.lit(1).cast("bigint")
    if category:
        found += _per_category(categories, "_category", one, "_rows_")
    if value:
        found += [F.sum("_value").alias("_sum"), F.count("_value").alias("_values")]
    if category and value:
        found += _per_category(categories, "_category", F.col("_value"), "_sum_")
        found += _per_category(categories, "_category", F.when(F.col("_value").isNotNull(), one), "_values_")
    return rows.groupBy("_key").agg(*found)


def joined_pivot(
    sides: Sequence[Side], category: tuple[int, str], value: tuple[int, str], categories: Sequence, stat: str = "mean", index: str = "key", count: str | None = None
) -> DataFrame:
    """One row per key of the inner join of all ``sides``, with a column per category.

    ``category`` and ``value`` name a side by its place and a column of it; they
    may be of one side or of two. ``stat`` is the mean or the sum of the value
    over the joined rows of the category; ``count`` names a further column with
    the number of joined rows of the key.
    """
    (at, by), (of, what) = category, value
    whole = None
    for n, side in enumerate(sides):
        factor = _factor(side, n, by if n == at else None, what if n == of else None, categories)
        whole = factor if whole is None else whole.join(factor, "_key")

    def times(*places: int) -> Column:
        """The rows that the other sides make of one row."""
        product = F.lit(1).cast("bigint")
        for n in range(len(sides)):
            if n not in places:
                product = product * F.col(f"_n{n}")
        return product

    columns = []
    for i, c in enumerate(categories):
        if at == of:
            there, total, values = F.col(f"_rows_{i}"), F.col(f"_sum_{i}"), F.col(f"_values_{i}")
        else:
            there, total, values = F.col(f"_rows_{i}"), F.col("_sum"), F.col("_values")
        if stat == "mean":
            column = F.when(there > 0, F.try_divide(total, values))
        elif stat == "sum":
            column = F.when(there > 0, total * times(at, of) * (F.lit(1) if at == of else there))
        else:
            raise ValueError(f"unknown statistic: {stat}")
        columns.append(column.alias(str(c)))
    return whole.select(F.col("_key").alias(index), *([times().alias(count)] if count else []), *columns)
