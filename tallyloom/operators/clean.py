"""Cleaning: null and duplicate removal, normalising, filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.scalars import day


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=subset)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct. Copies collapse before the shuffle, so a much-copied row is no hot spot."""
    return df.dropDuplicates()


def clean_data(df: DataFrame) -> DataFrame:
    """Drop rows holding a null, then drop repeated rows."""
    return distinct_rows(drop_null_rows(df))


_STEPS = {"upper": F.upper, "trim": F.trim}


def normalise_strings(df: DataFrame, steps: Mapping[str, Iterable[str]]) -> DataFrame:
    """Apply the named steps to each column, e.g. ``{"name": ["upper", "trim"]}``."""
    changed: dict[str, Column] = {}
    for column, names in steps.items():
        expr = F.col(column)
        for name in names:
            expr = _STEPS[name](expr)
        changed[column] = expr
    return df.withColumns(changed)


def parse_days(df: DataFrame, *columns: str, strict: bool = True) -> DataFrame:
    return df.withColumns({c: day(c, strict) for c in columns})


def keep_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches a regular expression."""
    return df.where(F.col(column).rlike(pattern))


def keep_without(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column does not contain a literal text."""
    return df.where(~F.col(column).contains(text))


def keep_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.col(column).contains(text))


def keep_longer(df: DataFrame, array: str, n: int) -> DataFrame:
    """Rows whose array has more than ``n`` elements."""
    return df.where(F.size(array) > n)


def keep_known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def keep_members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))
