"""Readers for catalog tables, text, CSV, JSON, parquet, ranges and literals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

Schema = StructType | str


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path)


def lines_of(df: DataFrame, text: str, value: str = "value") -> DataFrame:
    """One row per line of a text column; the other columns are kept."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(F.split(F.col(text), "\r\n|\n|\r")).alias(value))


def read_csv(spark: SparkSession, path: str, schema: Schema, header: bool = True, **options) -> DataFrame:
    """CSV with a declared schema: numbers arrive as numbers and no inference pass is needed."""
    return spark.read.schema(schema).options(header=header, **options).csv(path)


def read_csv_untyped(spark: SparkSession, path: str, **options) -> DataFrame:
    """Headerless CSV, all strings, columns ``_c0``, ``_c1``, ..."""
    return spark.read.options(header=False, **options).csv(path)


def read_json(spark: SparkSession, path: str, schema: Schema, **options) -> DataFrame:
    """JSON lines, or files that hold one array of objects on one line."""
    return spark.read.schema(schema).options(**options).json(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def load(spark: SparkSession, fmt: str, path: str, schema: Schema | None = None, **options) -> DataFrame:
    """Read by format name. CSV has a header unless told otherwise; csv and json need a schema."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None and fmt != "text":
        reader = reader.schema(schema)
    if fmt == "csv":
        options.setdefault("header", True)
    return reader.options(**options).load(path)


def with_row_key(table: DataFrame, name: str = "row_key") -> DataFrame:
    """Add the file path and the position in the file: unique and stable for a parquet read."""
    return table.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(name))


def number_range(spark: SparkSession, stop: int, start: int = 0, partitions: int | None = None) -> DataFrame:
    return spark.range(start, stop, 1, partitions) if partitions else spark.range(start, stop)


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: Schema) -> DataFrame:
    """A small table written down in the program."""
    return spark.createDataFrame(list(rows), schema)
