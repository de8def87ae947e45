"""Sinks and catalog tables: write the stored tables, read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.scratch import scratch_path
from tallyloom.sinks import tables, writers
from tallyloom.sources import readers
from tallyloom.workload.registry import query, table


def _database(spark: SparkSession) -> str:
    """A new database inside the shared folder."""
    name = f"tallyloom_{uuid.uuid4().hex[:12]}"
    tables.create_database(spark, name, scratch_path(spark, "database"))
    return name


@query("SELECT * FROM customer")
def table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    name = f"{_database(spark)}.customer"
    # Twice: the second write replaces the first.
    for _ in range(2):
        tables.overwrite_table(table(spark, sf, "customer"), name)
    return readers.read_table(spark, name)


@query("SELECT * FROM orders")
def append_or_create(spark: SparkSession, sf: str) -> DataFrame:
    name = f"{_database(spark)}.orders"
    orders = table(spark, sf, "orders")
    done = F.col("o_orderstatus") == "F"
    tables.append_or_create(orders.where(done), name)
    tables.append_or_create(orders.where(~done), name)
    return readers.read_table(spark, name)


@query("SELECT * FROM customer")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    customer, path = table(spark, sf, "customer"), scratch_path(spark, "csv")
    writers.write_csv(customer, path)
    return readers.load(spark, "csv", path, customer.schema)


@query("SELECT CAST(c_custkey AS VARCHAR) AS _c0, c_name AS _c1, CAST(c_nationkey AS VARCHAR) AS _c2, c_mktsegment AS _c3, CAST(c_acctbal AS VARCHAR) AS _c4 FROM customer")
def csv_untyped(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal").write.csv(path)
    return readers.read_csv_untyped(spark, path)


@query("SELECT * FROM part")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    part, path = table(spark, sf, "part"), scratch_path(spark, "json")
    writers.write_json(part, path)
    return readers.read_json(spark, path, part.schema)


@query("SELECT * FROM part")
def json_array_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    part, path = table(spark, sf, "part"), scratch_path(spark, "json")
    writers.write_json_arrays(part, path)
    return readers.read_json(spark, path, part.schema)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS stored_rank FROM orders")
def sorted_write(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sorted")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    writers.write_sorted(orders, path, F.desc("o_totalprice"), F.asc("o_orderkey"))
    return writers.stored_rank(readers.read_parquet(spark, path))
