"""From member scores to predictions: blend, aggregate, project, clip, interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan.fixed_values import MEMBER_SEEDS
from lifespan.functions.arrays import linear_quantile
from lifespan.functions.scalar import clip_unit
from lifespan.operators import isotonic
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis


def age_blend(direct: Column, tree: Column, age: Column, threshold: float, low: float, high: float) -> Column:
    """Weighted mean of two experts; the weight of the direct one depends on age."""
    weight = F.when(age <= F.lit(threshold), F.lit(low)).otherwise(F.lit(high))
    return (1.0 - weight) * tree + weight * direct


def members_wide(members: DataFrame, key: list[str], value: str = "y_norm") -> DataFrame:
    """One row per window with the value of every expected seed and a complete flag."""
    seed_value = [F.max(F.when(F.col("seed") == s, F.col(value))).alias(f"m{s}") for s in MEMBER_SEEDS]
    known = F.col("seed").isin(*MEMBER_SEEDS)
    wide = members.groupBy(*key).agg(
        *seed_value, F.count(F.lit(1)).alias("n_members"), F.count_if(~known).alias("n_foreign")
    )
    whole = sg.all_of([F.col(f"m{s}").isNotNull() for s in MEMBER_SEEDS])
    return wide.withColumn(
        "complete", whole & (F.col("n_members") == len(MEMBER_SEEDS)) & (F.col("n_foreign") == 0)
    ).drop("n_members", "n_foreign")


def aggregate_members(mode: str, columns: list[str] | None = None) -> Column:
    """Median or mean of the three members (null if one is missing), or the first seed alone."""
    columns = columns or [f"m{s}" for s in MEMBER_SEEDS]
    if mode == "median3":
        whole = sg.all_of([F.col(c).isNotNull() for c in columns])
        return F.when(whole, F.get(F.sort_array(F.array(*columns)), F.lit(len(columns) // 2)))
    if mode == "mean3":
        return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    if mode == "seed17":
        return F.col(columns[0])
    raise ValueError(f"unknown aggregation {mode}")


def finish(
    scored: DataFrame,
    axis: Axis,
    rmax: float,
    aggregate: str = "median3",
    postprocess: str = "isotonic_nonincreasing",
) -> DataFrame:
    """Point prediction, interval and safety flags from three normalised members.

    ``scored`` is ``(unit_id, …, m17, m42, m73)``.  The point value and every member are
    projected together, so the rows of a unit move once.
    """
    members = [f"m{s}" for s in MEMBER_SEEDS]
    df = scored.withColumn("raw_norm", aggregate_members(aggregate))
    sources = {"raw_norm": "point_norm", **{m: f"{m}_safe" for m in members}}
    if postprocess == "isotonic_nonincreasing":
        df = isotonic.project_columns(df, axis, sources)
    else:
        for value, name in sources.items():
            df = isotonic.projected(df, axis, value, name, postprocess)
    df = df.withColumns({name: clip_unit(F.col(name)) * F.lit(rmax) for name in sources.values()})
    return interval(df, "point_norm", [f"{m}_safe" for m in members]).select(
        *sg.columns_of(scored),
        (F.col("raw_norm") * F.lit(rmax)).alias("y_pred_raw"),
        F.col("point_norm").alias("y_pred"),
        (F.col("raw_norm") * F.lit(rmax) != F.col("point_norm")).alias("clamped"),
        "p10",
        "p90",
        "ensemble_std",
    )


def interval(df: DataFrame, point: str, members: list[str]) -> DataFrame:
    """10 % and 90 % quantiles of the members, widened to hold the point value."""
    n = len(members)
    ordered = df.withColumn("__ordered", F.sort_array(F.array(*members)))
    mean = "(" + " + ".join(members) + f") / {n}"
    squares = " + ".join(f"({m} - {mean}) * ({m} - {mean})" for m in members)
    return ordered.withColumns(
        {
            "p10": F.least(linear_quantile(F.col("__ordered"), n, 0.10), F.col(point)),
            "p90": F.greatest(linear_quantile(F.col("__ordered"), n, 0.90), F.col(point)),
            "ensemble_std": F.expr(f"sqrt(({squares}) / {n})"),
        }
    ).drop("__ordered")


def bound_violations(df: DataFrame, raw: str, rmax: float) -> DataFrame:
    """How many raw values lie below 0 or above the life scale, and how many were moved."""
    eps = max(1e-7, 1e-6 * rmax)
    return df.agg(
        F.count_if(F.col(raw) < -eps).alias("low_violations"),
        F.count_if(F.col(raw) > rmax + eps).alias("high_violations"),
        F.count_if("clamped").alias("clamped_rows"),
    )
