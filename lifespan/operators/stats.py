"""Fitted statistics: channel normalisation, feature normaliser, baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifespan.functions.scalar import finite


def fit_norm_stats(
    readings: DataFrame, channels: list[str], absent: list[str] = (), sample: bool = False
) -> DataFrame:
    """Mean and std per channel of training readings; one row per listed channel.

    A channel declared absent gets mean 0 and std 1, and is in error when it has a
    finite value.
    """
    value = F.when(finite(F.col("value")), F.col("value"))
    spread = F.stddev_samp(value) if sample else F.stddev_pop(value)
    gone = F.col("channel").isin(*absent) if absent else F.lit(False)
    return (
        readings.where(F.col("channel").isin(*channels, *absent))
        .groupBy("channel")
        .agg(F.avg(value).alias("mean"), spread.alias("std"), F.count(value).alias("n"))
        .select(
            "channel",
            F.when(gone, 0.0).otherwise(F.col("mean")).alias("mean"),
            F.when(gone, 1.0).otherwise(F.col("std")).alias("std"),
            "n",
            gone.alias("absent"),
            (gone & (F.col("n") > 0)).alias("absent_has_values"),
        )
    )


def apply_norm(readings: DataFrame, stats: DataFrame, channels: list[str]) -> DataFrame:
    """(value - mean) / std per reading; what is not finite then becomes 0 and is flagged.

    ``stats`` is cut to the contract channels, so it is small enough to ship.
    """
    small = F.broadcast(stats.where(F.col("channel").isin(*channels)).select("channel", "mean", "std"))
    scaled = (F.col("value") - F.col("mean")) / F.when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)
    return (
        readings.join(small, "channel")
        .withColumn("norm", scaled)
        .withColumn("imputed", ~finite(F.col("norm")))
        .withColumn("norm", F.when(F.col("imputed"), 0.0).otherwise(F.col("norm")))
        .drop("mean", "std")
    )


def fit_feature_normaliser(features: DataFrame) -> DataFrame:
    """Mean and population std per feature position; a std below 1e-6 counts as 1."""
    spread = F.stddev_pop("value")
    return features.groupBy("position").agg(
        F.avg("value").alias("mean"), F.when(spread < 1e-6, 1.0).otherwise(spread).alias("std")
    )


def fit_baseline(bins: DataFrame, current: str, temp: str) -> DataFrame:
    """One row: least squares of current on temperature, and whether it is degenerate."""
    return bins.agg(
        F.regr_intercept(current, temp).alias("intercept"),
        F.regr_slope(current, temp).alias("slope"),
        F.count_if(F.col(current).isNotNull() & F.col(temp).isNotNull()).alias("n"),
        F.coalesce(F.var_pop(temp) <= 1e-12, F.lit(True)).alias("degenerate"),
    )
