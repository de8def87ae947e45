"""Work on the numbered parts of a table, and row replication.

A part is a column of the data, not a Spark partition, so results do not move
when the cluster or the file layout changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def keyed(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """The table laid out by its key columns, for several joins or groupings on the same keys.

    The keys stay ordinary columns. For a single join this is not needed: Spark
    lays out both sides itself.
    """
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def part_counts(df: DataFrame, part: str, name: str = "n_rows") -> DataFrame:
    return df.groupBy(part).agg(F.count("*").alias(name))


def total_rows(counts: DataFrame, name: str = "n_rows") -> DataFrame:
    return counts.agg(F.sum(name).alias(name))


def part_means(df: DataFrame, part: str, key: str, value: str, name: str = "mean") -> DataFrame:
    """Mean per key inside each part; parts are not merged."""
    return df.groupBy(part, key).agg(F.avg(value).alias(name))


def part_head(df: DataFrame, part: str, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each part. Tasks keep only their own first n before the shuffle."""
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_of_conditions(df: DataFrame, parts: Mapping[str, Column], tag: str = "part") -> DataFrame:
    """The union of ``df.where(condition)`` over named conditions, in one scan; ``tag`` names the part.

    A row appears once for every condition that holds.
    """
    tags = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in parts.items()]))
    return df.select("*", F.explode(tags).alias(tag))


def union_totals(df: DataFrame, parts: Mapping[str, Column], keys: Sequence[str], values: Sequence[str], tag: str = "part") -> DataFrame:
    """Row counts (``n_rows``) and sums per part and key of :func:`union_of_conditions`.

    Rows are summed per combination of parts first and repeated after that, so
    overlapping parts do not multiply the rows.
    """
    held = [F.coalesce(condition, F.lit(False)).alias(f"_part{i}") for i, condition in enumerate(parts.values())]
    flags = [f"_part{i}" for i in range(len(parts))]
    sums = df.select(*keys, *values, *held).groupBy(*keys, *flags).agg(F.count("*").alias("n_rows"), *[F.sum(v).alias(v) for v in values])
    whole = union_of_conditions(sums, {name: F.col(flag) for name, flag in zip(parts, flags)}, tag)
    return whole.groupBy(tag, *keys).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(v).alias(v) for v in values])


def map_part_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a pandas function to batches of rows, wherever they are; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def replicate_rows(df: DataFrame, times: int, copy: str | None = None) -> DataFrame:
    """Every row ``times`` times, without a shuffle; ``copy`` names an optional copy number."""
    copies = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias(copy or "_copy"))
    return copies if copy else copies.drop("_copy")
