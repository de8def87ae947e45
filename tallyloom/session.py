"""Session presets."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

# Settings every preset shares. UTC keeps date arithmetic reproducible; AQE
# coalesces small shuffle partitions, splits skewed ones and turns a join into
# a broadcast join only once the measured size of a side allows it.
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed partition even if the next join then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}

LOCAL = {
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
}

CLUSTER = {
    # An upper bound: AQE merges what turns out to be too fine.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.dynamicAllocation.shuffleTracking.enabled": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.task.maxFailures": "8",
}


def shuffle_partitions_for(shuffle_bytes: int, target_bytes: int = 256 << 20, cores: int = 8) -> int:
    """Partitions that keep one reducer near ``target_bytes``, never fewer than the cores."""
    return max(cores, math.ceil(shuffle_bytes / target_bytes))


def build_session(
    app_name: str = "tallyloom",
    master: str | None = None,
    preset: str = "local",
    broadcast_joins: bool = True,
    checkpoint_dir: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or get) a session from a preset.

    ``broadcast_joins=False`` reproduces the runs that switch broadcast joins
    off altogether; it is a choice of the caller and off by default.
    """
    settings = dict(COMMON)
    settings.update({"local": LOCAL, "cluster": CLUSTER}[preset])
    if not broadcast_joins:
        settings["spark.sql.autoBroadcastJoinThreshold"] = "-1"
        settings["spark.sql.adaptive.autoBroadcastJoinThreshold"] = "-1"
    if checkpoint_dir:
        settings["spark.checkpoint.dir"] = checkpoint_dir
    settings.update(extra or {})

    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
