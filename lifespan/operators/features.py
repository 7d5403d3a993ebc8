"""Feature vectors of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan.fixed_values import AGE_FEATURES, INVARIANT_REDUCERS, STATISTICS
from lifespan.functions import arrays as ar
from lifespan.functions.scalar import age_features


def with_statistics(
    windows: DataFrame, length: int, channels: int, edge: int | None = None, name: str = "stats"
) -> DataFrame:
    """Add the thirteen statistics per channel: ``array<struct>`` in channel order."""
    per_channel = F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform("x", lambda row: F.get(row, c))
    )
    series = windows.withColumn("__series", per_channel)
    return series.withColumn(
        name, F.transform("__series", lambda s: ar.channel_statistics(s, length, edge))
    ).drop("__series")


def statistic_major(stats: str = "stats") -> Column:
    """All channels of the first statistic, then of the second, and so on."""
    return ar.let(F.col(stats), lambda a: F.flatten(F.array(*[a[n] for n in STATISTICS])))


def flat_window() -> Column:
    """Window values row by row."""
    return F.flatten("x")


def direct_features(age: str, scale, stats: str = "stats") -> Column:
    return F.concat(statistic_major(stats), age_features(F.col(age), scale))


def invariant_features(age: str, scale, channels: int, stats: str = "stats") -> Column:
    """Spread of each statistic over the channels, reducer by reducer, then age."""
    per_statistic = ar.let(F.col(stats), lambda a: F.array(*[a[n] for n in STATISTICS]))
    spreads = F.transform(per_statistic, lambda values: ar.spread(values, channels))
    ordered = ar.let(spreads, lambda a: F.concat(*[a[r] for r in INVARIANT_REDUCERS]))
    return F.concat(ordered, age_features(F.col(age), scale))


def feature_names(channels: list[str]) -> list[str]:
    return [f"{c}:{s}" for s in STATISTICS for c in channels] + list(AGE_FEATURES)


def invariant_names() -> list[str]:
    return [f"{r}:{s}" for r in INVARIANT_REDUCERS for s in STATISTICS] + list(AGE_FEATURES)


def explode_features(df: DataFrame, vector: str, names: list[str], keys: list[str]) -> DataFrame:
    """Long form: one row per window and feature name."""
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(*keys, F.posexplode(vector).alias("position", "value")).select(
        *keys, "position", F.get(labels, F.col("position")).alias("feature"), "value"
    )
