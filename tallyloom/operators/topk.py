"""Sorting, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sort_descending(df: DataFrame, *columns: str) -> DataFrame:
    """Global sort, largest first, nulls last."""
    return df.orderBy(*[F.desc(c) for c in columns])


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in the given order; without one, any ``n`` rows."""
    return (df.orderBy(*order) if order else df).limit(n)


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The ``k`` rows with the largest value. Each task sends at most k rows on."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)
