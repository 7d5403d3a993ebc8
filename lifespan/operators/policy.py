"""Maintenance policy on finished predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifespan.fixed_values import CRITICAL_SHARE
from lifespan.functions.scalar import finite, finite_or_null
from lifespan.operators import segments as sg


def risk_state(rows: DataFrame, margin: float, order: list[str], p10: str = "p10") -> DataFrame:
    """State of a unit by its first finite lower bound."""
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    known = F.when(finite(F.col(p10)), position)
    first = rows.groupBy("unit_id").agg(F.min_by(F.col(p10), known).alias("first_p10"))
    return first.withColumn(
        "risk",
        F.when(F.col("first_p10").isNull(), "unknown")
        .when(F.col("first_p10") <= margin * CRITICAL_SHARE, "critical")
        .when(F.col("first_p10") <= margin, "caution")
        .otherwise("nominal"),
    )


def maintenance_slack(rows: DataFrame, margin: float, p10: str = "p10") -> DataFrame:
    """Time left before the maintenance margin, null without a lower bound."""
    bound = finite_or_null(F.col(p10))
    return rows.withColumn("slack", F.when(bound.isNotNull(), F.greatest(F.lit(0.0), bound - margin)))


def replay_state(telemetry: DataFrame, predictions: DataFrame, estimates: list[str]) -> DataFrame:
    """Which units have finite telemetry or a usable prediction to replay."""
    seen = telemetry.groupBy("unit_id").agg(F.bool_or(finite(F.col("value"))).alias("has_telemetry"))
    usable = finite(F.col("t_end")) & sg.any_of([finite(F.col(c)) for c in estimates])
    scored = predictions.groupBy("unit_id").agg(F.bool_or(usable).alias("has_prediction"))
    joined = seen.join(scored, "unit_id", "full").na.fill(False, ["has_telemetry", "has_prediction"])
    return joined.withColumn(
        "state",
        F.when(F.col("has_telemetry") | F.col("has_prediction"), "ready").otherwise("unavailable"),
    )


def comparable_series(rows: DataFrame, series: list[str], truth: str = "y_true") -> DataFrame:
    """Prediction columns with at least one row of finite truth and estimate, per unit."""
    flags = [F.bool_or(finite(F.col(truth)) & finite(F.col(s))).alias(s) for s in series]
    per_unit = rows.groupBy("unit_id").agg(*flags)
    return per_unit.unpivot(["unit_id"], series, "series", "comparable")
