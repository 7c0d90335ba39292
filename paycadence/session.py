"""A Spark session with the settings the reports rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins and split skewed partitions at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows of one hot key compress well, so a skewed partition looks small in bytes.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Building a plan takes a call per column expression; do not record a stack trace for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Local runs pass a master; on a cluster it comes from spark-submit."""
    builder = SparkSession.builder.appName("paycadence")
    if master is not None:
        builder = builder.master(master)
    settings = dict(SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()})
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
