"""Databases and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{where}")


def overwrite_table(df: DataFrame, name: str, using: str = "parquet") -> None:
    df.write.format(using).mode("overwrite").saveAsTable(name)


def append_or_create(df: DataFrame, name: str, using: str = "parquet", **properties: str) -> str:
    """Append a batch, creating the table only if it is absent; returns what was done.

    A batch must have the table's columns, in any order: one that lacks some or
    brings others raises, so that nothing is dropped without a word. An append
    that fails raises and leaves the stored rows alone. Set ``using``
    to another table format where its connector is installed.
    """
    if df.sparkSession.catalog.tableExists(name):
        # By name, so a batch whose columns come in another order lands right.
        columns = df.sparkSession.table(name).columns
        if odd := set(columns) ^ set(df.columns):
            raise ValueError(f"columns that only the table or only the batch has: {sorted(odd)}")
        df.select(*columns).write.format(using).mode("append").saveAsTable(name)
        return "appended"
    df.write.format(using).options(**properties).saveAsTable(name)
    return "created"


def list_databases(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    like = f" LIKE '{pattern}'" if pattern else ""
    return spark.sql(f"SHOW DATABASES{like}")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {database}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
