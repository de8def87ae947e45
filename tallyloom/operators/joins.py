"""Equi-joins: chains, suffix rules, derived dimensions.

No join here carries a broadcast hint. Spark broadcasts a side whose known or
measured size is below its threshold and sorts or hashes otherwise, and
adaptive execution splits a skewed partition of a shuffled join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.scratch import materialise

On = str | list[str]


def inner_join(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    return left.join(right, on, "inner")


def left_join(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    return left.join(right, on, "left")


def left_join_chain(fact: DataFrame, steps: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """``fact`` left-joined with every (table, key) in turn.

    Neighbouring steps on one key are first joined with each other (full outer,
    and only for keys that the fact has). That gives the same rows as the plain
    chain, also when keys repeat, but the large table meets each key in a single
    join, and rows of a key that the fact lacks are never multiplied with each
    other. The combined table is stored: its size is then known, and
    beyond a broadcast both sides of the join come straight from a shuffle,
    which is what adaptive execution needs to split a skewed partition.

    Groups whose keys the fact itself has are joined in the order of the columns
    they add, fewest first: the wide ones are then not shuffled again for the
    next key. The columns come out as in the plain chain.
    """
    grouped: list[tuple[str, list[DataFrame]]] = []
    for table, key in steps:
        if grouped and grouped[-1][0] == key:
            grouped[-1][1].append(table)
        else:
            grouped.append((key, [table]))
    names = list(fact.columns)
    for key, tables in grouped:
        names = [key, *[c for c in names if c != key], *[c for t in tables for c in t.columns if c != key]]
    own = fact.columns
    joined = fact
    if len(set(names)) == len(names) and all(key in own for key, _ in grouped):
        grouped.sort(key=lambda g: sum(len(t.columns) for t in g[1]))
    for key, tables in grouped:
        if len(tables) == 1:
            joined = left_join(joined, tables[0], key)
            continue
        # The joins so far add no values to the fact's own columns.
        asked = materialise((fact if key in own else joined).where(F.col(key).isNotNull()).select(key).distinct(), "keys")
        known = [t.join(asked, key, "left_semi") for t in tables]
        combined = materialise(reduce(lambda a, b: a.join(b, key, "full"), known), "combined")
        joined = left_join(joined, combined, key)
    return joined if joined.columns == names else joined.select(*names)


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: what a join on them would multiply by."""
    return table.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def hash_join(large: DataFrame, small: DataFrame, on: On) -> DataFrame:
    """Inner join that asks for a shuffled hash join built on the smaller side."""
    return large.join(small.hint("shuffle_hash"), on, "inner")


def suffix_join(left: DataFrame, right: DataFrame, on: str, left_suffix: str, right_suffix: str) -> DataFrame:
    """Inner join in which only names that occur on both sides get a suffix."""
    shared = (set(left.columns) & set(right.columns)) - {on}

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c + suffix) if c in shared else F.col(c) for c in df.columns])

    return renamed(left, left_suffix).join(renamed(right, right_suffix), on, "inner")


def suffix_join_all(tables: Sequence[DataFrame], on: str) -> DataFrame:
    """Join tables in turn; the n-th one uses the suffixes ``_left<n>`` and ``_right<n>``."""
    joined = tables[0]
    for n, table in enumerate(tables[1:], start=2):
        joined = suffix_join(joined, table, on, f"_left{n}", f"_right{n}")
    return joined


def derived_dimension(df: DataFrame, key: str, label: Column, name: str) -> DataFrame:
    """The distinct (key, label) pairs of a table whose label depends on the key alone."""
    return df.select(key, label.alias(name)).distinct()


def join_derived_dimension(df: DataFrame, key: str, label: Column, name: str) -> DataFrame:
    """Join a table with the dimension derived from it; rows without a key drop out.

    The dimension is stored first, so its true size decides how it is joined and
    the large table is shuffled only if the dimension is too big to broadcast.
    """
    return inner_join(df, materialise(derived_dimension(df, key, label, name), "dimension"), key)


def with_derived_label(df: DataFrame, key: str, label: Column, name: str) -> DataFrame:
    """The rows of :func:`join_derived_dimension` without the join.

    Each key has exactly one dimension row, found by evaluating the label, so
    the join only drops null keys.
    """
    return df.where(F.col(key).isNotNull()).withColumn(name, label)
