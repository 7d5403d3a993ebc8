"""Time bins, cycles and crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.functions.scalar import battery_health
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis

BIN_STATISTICS = ("mean", "std", "min", "max")


def bin_aggregate(
    readings: DataFrame, channels: list[str], width: float, t: str = "t", keys: list[str] = ("unit_id",)
) -> DataFrame:
    """One row per unit and bin with mean, sample std, min and max of every channel.

    One hash aggregation with map-side partials; the std of a single reading is null.
    """
    aggs = []
    for c in channels:
        v = F.when(F.col("channel") == c, F.col("value"))
        aggs += [
            F.avg(v).alias(f"{c}.mean"),
            F.stddev_samp(v).alias(f"{c}.std"),
            F.min(v).alias(f"{c}.min"),
            F.max(v).alias(f"{c}.max"),
            F.count(v).alias(f"{c}.n"),
        ]
    used = readings.where(F.col("channel").isin(*channels))
    return used.groupBy(*keys, F.floor(F.col(t) / F.lit(float(width))).alias("bin")).agg(
        F.max(t).alias("t_end"), *aggs
    )


def reconstruct_cycles(
    samples: DataFrame,
    period: float,
    sample_period: float,
    q0: float = fv.NOMINAL_CAPACITY_AH,
    per_cycle: int | None = fv.SAMPLES_PER_ORBIT,
) -> DataFrame:
    """One row per full cycle of a battery history.

    ``samples`` has ``unit_id, t, current, temp, soh, hi``.  The capacity of cycle k is
    that of the first sample of cycle k + 1, so the last cycle has none and is dropped.
    """
    cycle = F.floor(F.col("t") / F.lit(float(period)) + 1e-9)
    parts = (
        samples.withColumn("cycle", cycle)
        .groupBy("unit_id", "cycle")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.avg("temp").alias("temp_mean"),
            (F.count_if(F.col("current") < 0) * F.lit(float(sample_period))).alias("charge_time"),
            (F.avg(F.abs("current")) / F.lit(q0)).alias("c_rate_mean"),
            F.min_by("soh", "t").alias("first_soh"),
            F.min_by("hi", "t").alias("first_hi"),
        )
    )
    own = ["n_samples", "temp_mean", "charge_time", "c_rate_mean"]
    none = F.lit(None).cast("double")
    # a cycle hands its first values to the cycle before it; the cycles are built once
    mine = F.struct("cycle", *own, none.alias("soh"), none.alias("hi"))
    before = F.struct(
        (F.col("cycle") - 1).alias("cycle"),
        *[F.lit(None).cast("bigint" if c == "n_samples" else "double").alias(c) for c in own],
        F.col("first_soh").alias("soh"),
        F.col("first_hi").alias("hi"),
    )
    joined = (
        parts.select("unit_id", F.explode(F.array(mine, before)).alias("c"))
        .groupBy("unit_id", "c.cycle")
        .agg(*[F.max(f"c.{c}").alias(c) for c in (*own, "soh", "hi")])
        .where(F.col("n_samples").isNotNull() & F.col("soh").isNotNull())
    )
    if per_cycle is not None:
        joined = joined.where(F.col("n_samples") == per_cycle)
    return joined.withColumn("capacity", F.lit(q0) * F.col("soh")).withColumn(
        "hi_matches", F.abs(F.col("hi") - battery_health(F.col("soh"))) <= 5e-6
    )


def failure_cycle(
    cycles: DataFrame, q0: float = fv.NOMINAL_CAPACITY_AH, capacity: str = "capacity", cycle: str = "cycle"
) -> DataFrame:
    """First cycle at or below 80 % of nominal capacity, and the labels it gives."""
    reached = F.col(capacity) <= F.lit(fv.END_OF_LIFE_SOH * q0 + 1e-9)
    axis = Axis(("unit_id",), (cycle,), 50_000.0)
    first = F.min(F.when(reached, F.col(cycle)))
    return (
        sg.unit_values(cycles, axis, {"failure_cycle": (first, F.min)})
        .withColumn("censored", F.col("failure_cycle").isNull())
        .withColumn("rul", F.col("failure_cycle") - F.col(cycle))
        .withColumn("fail", F.coalesce(F.col(cycle) >= F.col("failure_cycle"), F.lit(False)).cast("int"))
    )


def failure_cross_check(labelled: DataFrame, failure_days: str, period: float = fv.ORBIT_PERIOD_S) -> DataFrame:
    """Units whose failure cycle is more than one cycle from the time-domain value."""
    exact = F.floor(F.col(failure_days) * 86400.0 / F.lit(period) + 1e-9)
    return labelled.where(F.abs(exact - F.col("failure_cycle")) > 1)


def first_crossing(df: DataFrame, axis: Axis, value: str, threshold: float) -> DataFrame:
    """First time a value reaches a threshold, interpolated between two samples."""
    t = axis.order[0]
    pairs = sg.previous_row(df, axis, [t, value], "prev_")
    low, high = F.col(f"prev_{value}"), F.col(value)
    crossed = (high >= threshold) & (low.isNull() | (low < threshold))
    share = (F.lit(threshold) - low) / (high - low)
    when = F.when(low.isNull(), F.col(t)).otherwise(
        F.col(f"prev_{t}") + share * (F.col(t) - F.col(f"prev_{t}"))
    )
    return pairs.where(crossed).groupBy(*axis.unit).agg(F.min(when).alias("crossing_time"))


def sustained_exceedance(df: DataFrame, axis: Axis, value: str, limit: float, duration: float) -> DataFrame:
    """First start of a run of values over a limit that lasts at least ``duration``."""
    t = axis.order[0]
    over = df.withColumn("__over", (F.col(value) > F.lit(limit)).cast("int"))
    pairs = sg.previous_row(over, axis, ["__over"], "prev_")
    starts = pairs.withColumn(
        "__start", ((F.col("__over") == 1) & (F.coalesce("prev___over", F.lit(0)) == 0)).cast("int")
    )
    runs = sg.running_sum(starts, axis, "__start", "__run").where(F.col("__over") == 1)
    return (
        runs.groupBy(*axis.unit, "__run")
        .agg(F.min(t).alias("start"), F.max(t).alias("stop"))
        .where(F.col("stop") - F.col("start") >= duration)
        .groupBy(*axis.unit)
        .agg(F.min("start").alias("first_time"))
    )


def unit_registry(
    rows: DataFrame, t: str = "t", failure_time: Column | None = None, failure_code: Column | None = None
) -> DataFrame:
    """Per unit: row count, time range, failure time, censoring and failure mode.

    ``failure_time`` and ``failure_code`` are aggregates over the rows of a unit; by default the
    rows carry them as columns.
    """
    failure_time = F.max("failure_time") if failure_time is None else failure_time
    failure_code = F.max("failure_code") if failure_code is None else failure_code
    names = F.create_map(*[F.lit(x) for kv in fv.FAILURE_CODES.items() for x in kv])
    grouped = rows.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(t).alias("t_start"),
        F.max(t).alias("t_end"),
        failure_time.alias("failure_time"),
        failure_code.alias("failure_code"),
    )
    code = F.when(F.col("failure_time").isNull(), 0).otherwise(F.col("failure_code"))
    return (
        grouped.withColumn("censored", F.col("failure_time").isNull())
        .withColumn("failure_mode", F.coalesce(F.try_element_at(names, code), code.cast("string")))
        .withColumn("file", F.concat(F.lit("unit_"), F.col("unit_id"), F.lit(".parquet")))
    )
