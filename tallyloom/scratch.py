"""Intermediate tables in the folder all executors share.

Iterative jobs cut their lineage by writing a table here and reading it back:
the files outlive any executor, and Spark knows their size when it plans the
next join, so small ones are broadcast and large ones are not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session, or a fresh temporary one in local mode only."""
    context = spark.sparkContext
    shared = spark.conf.get(_CONF, None) or context.getConf().get(_CONF) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tallyloom-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that nobody else uses."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(table: DataFrame, target_bytes: int = 64 << 20) -> int:
    """Partitions for a stored table, by the size Spark knows, never fewer than the cores."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-size // target_bytes))


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Delete the files of a superseded scratch table."""
    jvm = spark.sparkContext._jvm
    hadoop_conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = scratch_root(spark)
    for file in table.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if root.rstrip("/").split(":")[-1].lstrip("/") in folder.toString():
            folder.getFileSystem(hadoop_conf).delete(folder, True)
            break


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage.

    For loops whose results are stored. Those behind a persisted table stay.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
