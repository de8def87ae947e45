"""Self-joins of a wide table, then a pivot of means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.aggregates import pivot_mean, self_join_pivot_mean
from tallyloom.operators.joins import suffix_join_all
from tallyloom.sinks.writers import write_parquet
from tallyloom.sources.datagen import WIDE_CATEGORIES


def joined_rows(tables: Sequence[DataFrame], on: str = "unique_id") -> DataFrame:
    """All rows of the joins. A key that occurs n times in each of k tables gives n**k rows."""
    return suffix_join_all(tables, on)


def pivot_of_joined_rows(tables: Sequence[DataFrame], on: str = "unique_id", category: str = "col1_left2",
                         value: str = "col2_left2", categories: Sequence[str] = WIDE_CATEGORIES) -> DataFrame:
    """Join first, then pivot: for keys that are (nearly) unique."""
    return pivot_mean(joined_rows(tables, on), on, category, value, categories)


def join_pivot(tables: Sequence[DataFrame], on: str = "unique_id", category: str = "col1", value: str = "col2",
               categories: Sequence[str] = WIDE_CATEGORIES) -> DataFrame:
    """The same means without the joined rows; reads three columns of the first table and one of the others."""
    first, *others = tables
    return self_join_pivot_mean(first, others, on, category, value, categories)


def run(tables: Sequence[DataFrame], output: str, **options) -> None:
    write_parquet(join_pivot(tables, **options), output)
