"""The whole way from steps to predictions with intervals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan.config import SEGMENT_ROWS
from lifespan.fixed_values import MEMBER_SEEDS
from lifespan.functions.scalar import finite
from lifespan.operators import ensemble, features, windows
from lifespan.operators.segments import Axis

WINDOW_AXIS = Axis(("unit_id",), ("window_index",), float(SEGMENT_ROWS))

# Given windows with ``stats``, ``age`` and ``age_scale``, add ``direct_<seed>`` and
# ``tree_<seed>`` in units of the life scale.
Predictor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ScoringPlan:
    channels: tuple[str, ...]
    length: int
    stride: int
    rmax: float
    age_threshold: float
    low_weight: float
    high_weight: float
    aggregate: str = "median3"
    postprocess: str = "isotonic_nonincreasing"


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    packed = df.withColumn("__fitted", row.select(F.struct("*")).scalar())
    return packed.select(*[c for c in df.columns], "__fitted.*")


def step_statistics(train: DataFrame, channels: tuple[str, ...], *more: Column) -> DataFrame:
    """One row: mean and population std of every channel over training steps, and further aggregates."""
    return train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in channels],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in channels],
        *more,
    )


def normalise_steps(steps: DataFrame, fitted: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Scale the channels; what is not finite becomes 0 and is counted per step."""
    df = attach_row(steps, fitted)
    scaled = {
        c: (F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") > 1e-12, F.col(f"{c}__std")).otherwise(1.0)
        for c in channels
    }
    imputed = sum(((~finite(v)).cast("int") for v in scaled.values()), F.lit(0))
    kept = [c for c in df.columns if c not in channels and not c.endswith(("__mean", "__std"))]
    return df.select(
        *kept, imputed.alias("imputed_cells"), *[F.when(finite(v), v).otherwise(0.0).alias(c) for c, v in scaled.items()]
    )


def score(windowed: DataFrame, plan: ScoringPlan, predictor: Predictor, axis: Axis = WINDOW_AXIS) -> DataFrame:
    """Members, age blend, aggregation, projection, clipping and interval.

    ``axis`` says whether the windows of every unit are known to be few.
    """
    scored = predictor(windowed)
    blended = scored.select(
        "unit_id",
        "window_index",
        "t_end",
        *[c for c in ("y_true",) if c in scored.columns],
        *[
            ensemble.age_blend(
                F.col(f"direct_{s}"), F.col(f"tree_{s}"), F.col("age"), plan.age_threshold, plan.low_weight, plan.high_weight
            ).alias(f"m{s}")
            for s in MEMBER_SEEDS
        ],
    )
    return ensemble.finish(blended, axis, plan.rmax, plan.aggregate, plan.postprocess)


def window_features(steps: DataFrame, plan: ScoringPlan, carry: list[str], axis: Axis = WINDOW_AXIS) -> DataFrame:
    w = windows.sliding_windows(steps, list(plan.channels), plan.length, plan.stride, carry=carry, axis=axis)
    return features.with_statistics(w, plan.length, len(plan.channels)).drop("x")


def predict_batch(
    steps: DataFrame, plan: ScoringPlan, predictor: Predictor, axis: Axis = WINDOW_AXIS
) -> DataFrame:
    """Normalised steps ``(unit_id, step, t, age, [y_true], channels…)`` in, predictions out."""
    carry = [c for c in ("t", "age", "age_scale", "y_true") if c in steps.columns]
    windowed = window_features(steps, plan, carry, axis)
    return score(windowed.withColumnRenamed("t", "t_end"), plan, predictor, axis)
