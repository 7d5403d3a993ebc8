"""Bin aggregation of a live reading stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bins(
    readings: DataFrame, channels: list[str], width_seconds: float, lateness: str, ts: str = "ts"
) -> DataFrame:
    """The bin table of ``binning.bin_aggregate`` for a stream with event times.

    A bin is emitted once the watermark has passed its end; readings later than
    ``lateness`` are dropped by Spark.  State is one row per unit and open bin.
    """
    aggs = []
    for c in channels:
        v = F.when(F.col("channel") == c, F.col("value"))
        aggs += [
            F.avg(v).alias(f"{c}.mean"),
            F.stddev_samp(v).alias(f"{c}.std"),
            F.min(v).alias(f"{c}.min"),
            F.max(v).alias(f"{c}.max"),
        ]
    return (
        readings.withWatermark(ts, lateness)
        .where(F.col("channel").isin(*channels))
        .groupBy("unit_id", F.window(ts, f"{width_seconds} seconds").alias("w"))
        .agg(F.max(ts).alias("t_end"), *aggs)
        .withColumn("bin_start", F.col("w.start"))
        .drop("w")
    )
