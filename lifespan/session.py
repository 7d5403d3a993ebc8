"""Settings the jobs are written for.  All of them are ordinary Spark settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # plan again at run time; split what is still skewed after the segments
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # time stamps are compared in UTC
    "spark.sql.session.timeZone": "UTC",
    # rows that hold whole files are sent to Python in batches of bounded size
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def tune(spark: SparkSession, shuffle_partitions: int | None = None) -> SparkSession:
    """Apply the settings to a running session.

    On a large cluster start with many shuffle partitions (two or three per core, at
    least input bytes / 200 MB); adaptive execution joins the small ones.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark
