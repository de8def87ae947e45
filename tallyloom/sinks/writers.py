"""File sinks and small looks at a result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _one_array_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch({"value": ["[" + ",".join(batch.column(0).to_pylist()) + "]"]})


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON files whose lines are arrays of objects, as :func:`tallyloom.sources.readers.read_json` takes them.

    An array holds one Arrow batch, which Spark bounds in rows and bytes, so a
    large file is several arrays. Null fields are left out; an empty table gives
    no array.
    """
    objects = df.select(F.to_json(F.struct("*")).alias("value"))
    objects.mapInArrow(_one_array_per_batch, "value string").write.mode(mode).text(path)


def write_sorted(df: DataFrame, path: str, *order: Column) -> None:
    """Global sort, then parquet: reading the part files by name gives the sorted rows.

    The sort is a range exchange, so every part file covers its own key range.
    """
    write_parquet(df.orderBy(*order), path)


def stored_rank(table: DataFrame, name: str = "stored_rank") -> DataFrame:
    """Number the rows of a stored parquet table in file order, from 1.

    Only the per-file row counts are accumulated; rows are numbered from their
    position in the file.
    """
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    # One row per part file; the number in its name, not the name as text, gives the order.
    number = F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("bigint")
    before = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_file").count().select("_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return rows.join(offsets, "_file").withColumn(name, F.col("_start") + F.col("_pos") + 1).drop("_file", "_pos", "_start")


def show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def gather(df: DataFrame, n: int = 1000) -> list[Row]:
    """The rows of a small result, for the driver; raises if there are more than ``n``."""
    found = df.limit(n + 1).collect()
    if len(found) > n:
        raise ValueError(f"more than {n} rows")
    return found


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan Spark would run, as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
