"""Row counts, heads and means of the parts of a key-value table, then of the whole."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.operators.aggregates import group_mean
from tallyloom.operators.part_functions import fold_parts, map_whole_parts
from tallyloom.operators.partitions import part_counts, part_head, part_means, total_rows


def part_report(df: DataFrame, part: str = "part_id", key: str = "key", value: str = "value") -> dict[str, DataFrame]:
    counts = part_counts(df, part)
    return {
        "head": part_head(df, part, [key, value]),
        "counts": counts,
        "total": total_rows(counts),
        "part_means": part_means(df, part, key, value),
        "means": group_mean(df, [key], value),
    }


def longest_rise(df: DataFrame, part: str, order: Sequence[str], value: str) -> DataFrame:
    """Per part the most rows in a row, by ``order``, of which each has a larger value than the one before.

    A row without a value ends a rise and is in none; a part without values has 0.
    """

    def run(key: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = length = 0
        before = np.nan
        for batch in batches:
            values = np.concatenate([[before], batch.column(value).to_numpy(zero_copy_only=False).astype(np.float64)])
            rises = values[1:] > values[:-1]
            there = ~np.isnan(values[1:])
            # Rows since the last one that did not rise, itself included; the rise of the batch before goes on up to the first such row.
            at = np.arange(1, len(rises) + 1)
            stops = np.maximum.accumulate(np.where(rises, 0, at))
            lengths = np.where(stops == 0, length + at, at - stops + there[np.maximum(stops - 1, 0)])
            best, length, before = max(best, int(lengths.max(initial=0))), int(lengths[-1]) if len(lengths) else length, values[-1]
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([best], pa.int64())], names=[part, "longest"])

    kind = to_arrow_type(df.schema[part].dataType)
    return map_whole_parts(df.select(part, *order, value), part, run, f"`{part}` {df.schema[part].dataType.simpleString()}, longest bigint", order)


def spread_of_parts(df: DataFrame, part: str, value: str, **options) -> DataFrame:
    """Per part: rows, values, mean, population standard deviation, smallest and largest value, from states of six numbers."""

    def step(state: tuple, batch: pa.RecordBatch) -> tuple:
        values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.float64)
        values = values[~np.isnan(values)]
        if not len(values):
            return (state[0] + batch.num_rows, *state[1:])
        mean = float(values.mean())
        return merge(state, (batch.num_rows, len(values), mean, float(((values - mean) ** 2).sum()), float(values.min()), float(values.max())))

    def merge(a: tuple, b: tuple) -> tuple:
        """Counts, means and sums of squared distances of two sets of values put together."""
        n = a[1] + b[1]
        if not a[1] or not b[1]:
            return (a[0] + b[0], *(b if b[1] else a)[1:])
        apart = b[2] - a[2]
        return (a[0] + b[0], n, a[2] + apart * b[1] / n, a[3] + b[3] + apart * apart * a[1] * b[1] / n, min(a[4], b[4]), max(a[5], b[5]))

    def finish(s: tuple) -> dict:
        known = s[1] > 0
        return {
            "n_rows": s[0], "n_values": s[1], "mean": s[2] if known else None, "std": math.sqrt(s[3] / s[1]) if known else None,
            "low": s[4] if known else None, "high": s[5] if known else None,
        }

    schema = "n_rows bigint, n_values bigint, mean double, std double, low double, high double"
    return fold_parts(df.select(part, F.col(value).cast("double").alias(value)), part, lambda: (0, 0, 0.0, 0.0, 0.0, 0.0), step, merge, finish, schema, **options)
