"""The given tables read as telemetry.

``events`` is a long table, ``lineitem`` a wide one per supplier and day,
``embeddings`` holds windows, ``orders`` prediction rows per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifespan.operators.segments import Axis, row_numbers

EPOCH_2024_S = 1704067200
EVENT_CHANNELS = ("click", "error", "purchase", "signup", "view")
STEP_CHANNELS = ("value", "k", "hour")
DAY_S = 86400.0


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def seconds(column) -> F.Column:
    """Seconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def event_readings(spark: SparkSession, base: str) -> DataFrame:
    """Long telemetry: unit, source row, time in seconds since 2024, channel, value."""
    e = read(spark, base, "events")
    return e.select(
        F.col("user_id").alias("unit_id"),
        F.col("event_id").alias("row_number"),
        (seconds("ts") - F.lit(EPOCH_2024_S)).alias("t"),
        F.col("event_type").alias("channel"),
        "value",
    )


def event_axis(spark: SparkSession, base: str) -> Axis:
    """Axis of the event times, cut where a user has very many events."""
    keyed = read(spark, base, "events").select(
        F.col("user_id").alias("unit_id"), (seconds("ts") - F.lit(EPOCH_2024_S)).alias("t"), F.col("event_id").alias("row_number")
    )
    return Axis.fit(keyed, ("unit_id",), ("t", "row_number"))


def event_rows(spark: SparkSession, base: str) -> DataFrame:
    """Wide telemetry without positions: every event is one row with three channels."""
    e = read(spark, base, "events")
    return e.select(
        F.col("user_id").alias("unit_id"),
        F.col("event_id").alias("row_number"),
        (seconds("ts") - F.lit(EPOCH_2024_S)).alias("t"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hour"),
    )


def event_steps(spark: SparkSession, base: str, axis: Axis | None = None) -> DataFrame:
    """The event rows numbered 0, 1, 2, … inside each unit."""
    return row_numbers(event_rows(spark, base), axis or event_axis(spark, base), "step", "n_steps")


def supplier_days(spark: SparkSession, base: str) -> DataFrame:
    """Wide telemetry per supplier and day; decimals keep the sums exact."""
    li = read(spark, base, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return (
        li.groupBy(F.col("l_suppkey").alias("unit_id"), F.to_date("l_shipdate").alias("day"))
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
            F.sum(price).cast("double").alias("price"),
            F.max("l_discount").alias("discount"),
            F.max("l_tax").alias("tax"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        .withColumn("t", F.datediff("day", F.lit("1992-01-01").cast("date")).cast("double"))
    )


# one row per unit and calendar day, so a unit is small by construction
DAY_AXIS = Axis(("unit_id",), ("t",))


def embedding_windows(spark: SparkSession, base: str, length: int = 16, channels: int = 4) -> DataFrame:
    """Windows of ``length`` steps by ``channels`` values taken from the vectors."""
    v = read(spark, base, "embeddings")
    flat = F.col("embedding").cast("array<double>")
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.slice(flat, i * channels + 1, channels),
    )
    return v.select(
        F.col("vec_id").alias("unit_id"),
        F.lit(0).alias("window_index"),
        F.col("vec_id").cast("double").alias("t_end"),
        F.col("label").cast("double").alias("y"),
        rows.alias("x"),
    )
