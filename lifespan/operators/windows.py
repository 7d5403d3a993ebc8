"""Sliding windows, projections along time and downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifespan.config import SEGMENT_ROWS
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis
from lifespan.sources.storage import cut_lineage


def sliding_windows(
    steps: DataFrame,
    channels: list[str],
    length: int,
    stride: int,
    unit: str = "unit_id",
    step: str = "step",
    carry: list[str] = (),
    block: int = SEGMENT_ROWS,
    axis: Axis | None = None,
) -> DataFrame:
    """Windows of ``length`` steps starting every ``stride`` steps of a unit.

    ``step`` counts 0, 1, 2, … inside the unit.  ``x`` holds the window row by row,
    ``carry`` columns are those of the last step.  A unit is cut into blocks that
    overlap by ``length - 1`` steps, so no task holds a whole unit.  Where ``axis`` says
    that all units are small the blocks are left out, and steps that already lie
    together by unit are not moved again.
    """
    if stride > 1:
        return _chunked_windows(steps, channels, length, stride, unit, step, list(carry), block, axis)
    rows, keys = _framed(steps, unit, step, block, axis, before=length - 1)
    frame = Window.partitionBy(*keys).orderBy(step).rowsBetween(-(length - 1), 0)
    start = F.col(step) - (length - 1)
    return (
        rows.withColumn("x", F.collect_list(F.array(*[F.col(c).cast("double") for c in channels])).over(frame))
        .where(~F.col("__halo") & (start >= 0) & (start % stride == 0))
        .select(unit, (start / stride).cast("long").alias("window_index"), F.col(step).alias("end_step"), *carry, "x")
    )


def _chunked_windows(steps, channels, length, stride, unit, step, carry, block, axis):
    """Windows as runs of whole chunks of ``stride`` steps.

    A frame over single steps would build a list at every step and drop most of them.
    """
    n_chunks = -(-length // stride)
    block = max(1, block // stride) * stride
    rows, keys = _framed(steps, unit, step, block, axis, before=(n_chunks - 1) * stride)
    row = F.struct(step, F.array(*[F.col(c).cast("double") for c in channels]).alias("__x"), *carry)
    chunks = rows.groupBy(*keys, F.floor(F.col(step) / stride).alias("__chunk"), "__halo").agg(
        F.sort_array(F.collect_list(row)).alias("__rows")
    )
    frame = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(-(n_chunks - 1), 0)
    reach = length - (n_chunks - 1) * stride
    runs = chunks.withColumn("__run", F.flatten(F.collect_list("__rows").over(frame))).where(
        ~F.col("__halo") & (F.col("__chunk") >= n_chunks - 1) & (F.size("__rows") >= reach)
    )
    last = F.get("__run", F.lit(length - 1))
    return runs.select(
        unit,
        (F.col("__chunk") - (n_chunks - 1)).alias("window_index"),
        last[step].alias("end_step"),
        *[last[c].alias(c) for c in carry],
        F.slice(F.col("__run.__x"), 1, length).alias("x"),
    )


def _framed(steps, unit, step, block, axis, before=0, after=0):
    if axis is not None and axis.whole_units:
        return steps.withColumn("__halo", F.lit(False)), [unit]
    return sg.with_halo(steps, step, block, before, after), [unit, sg.BLOCK]


def window_count(rows: Column, length: int, stride: int) -> Column:
    """How many windows a unit of ``rows`` steps gives."""
    return F.when(rows >= length, F.floor((rows - length) / stride) + 1).otherwise(F.lit(0))


def label_allowed(label: str) -> Column:
    """Whether an end label is not below zero; an unknown one is allowed."""
    return F.col(label).isNull() | F.isnan(label) | (F.col(label) >= 0)


def drop_negative(windows: DataFrame, label: str) -> DataFrame:
    """Keep windows whose end label is not below zero (an unknown label stays)."""
    return windows.where(label_allowed(label))


def trend_targets(
    steps: DataFrame, label: str, horizon: int, unit: str = "unit_id", step: str = "step",
    block: int = SEGMENT_ROWS, axis: Axis | None = None,
) -> DataFrame:
    """The next ``horizon`` labels of each step and a mask of those that exist."""
    rows, keys = _framed(steps, unit, step, block, axis, after=horizon)
    frame = Window.partitionBy(*keys).orderBy(step).rowsBetween(1, horizon)
    ahead = F.collect_list(F.struct(F.col(label).alias("v"))).over(frame)
    return (
        rows.withColumn("__ahead", ahead)
        .where(~F.col("__halo"))
        .select(
            *sg.columns_of(steps),
            F.transform(
                F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.get("__ahead", h)["v"]
            ).alias("y_trend"),
        )
        .withColumn("mask", F.transform("y_trend", lambda v: v.isNotNull()))
    )


# -- downsampling ----------------------------------------------------------
def _kept_positions(position: Column, last: Column, points: int, rounded: bool) -> Column:
    """Is ``position`` one of ``points`` evenly spaced ones on 0..last?

    The candidate indices around the inverse map are tried, so no index list is joined.
    """
    delta = last / F.lit(float(points - 1))
    guess = F.floor(position / delta)
    hits = []
    for shift in (-1, 0, 1, 2):
        i = guess + shift
        exact = F.when(i == points - 1, last.cast("double")).otherwise(i * delta)
        index = F.bround(exact, 0) if rounded else F.floor(exact)
        hits.append((i >= 0) & (i <= points - 1) & (index == position))
    return sg.any_of(hits)


def downsample_even(df: DataFrame, axis: Axis, points: int) -> DataFrame:
    """At most ``points`` existing rows per unit at truncated even positions."""
    n = sg.row_numbers(df, axis, "position", "source_points")
    keep = (F.col("source_points") <= points) | _kept_positions(
        F.col("position"), F.col("source_points") - 1, points, rounded=False
    )
    return n.where(keep).withColumn("display_points", F.least(F.col("source_points"), F.lit(points)))


def downsample_until(df: DataFrame, axis: Axis, limit_time: str, points: int) -> DataFrame:
    """Rows up to the first one at or after ``limit_time``, thinned with both ends kept."""
    n = sg.row_numbers(df, axis, "position", "n_rows")
    early = F.count_if(F.col(axis.order[0]) < F.col(limit_time))
    counted = sg.unit_values(n, axis, {"__early": (early, F.sum)})
    stop = F.least(F.greatest(F.col("__early"), F.lit(1)), F.col("n_rows") - 1)
    joined = counted.withColumn("stop", stop).drop("__early").where(F.col("position") <= F.col("stop"))
    keep = (F.col("stop") + 1 <= points) | _kept_positions(
        F.col("position"), F.col("stop"), points, rounded=True
    )
    return joined.where(keep).drop("n_rows")


def downsample_stride(df: DataFrame, axis: Axis, points: int) -> DataFrame:
    """Every k-th row, k the smallest step that leaves at most ``points`` rows."""
    n = sg.row_numbers(df, axis, "position", "n_rows")
    return n.where(F.col("position") % F.ceil(F.col("n_rows") / points) == 0)


def row_at_progress(df: DataFrame, axis: Axis, progress: float) -> DataFrame:
    """The row at a share of the history of each unit."""
    n = sg.row_numbers(df, axis, "position", "n_rows")
    wanted = F.floor(F.lit(float(progress)) * (F.col("n_rows") - 1) + 0.5)
    return n.where(F.col("position") == wanted)


def running_minimum(df: DataFrame, axis: Axis, value: str, name: str) -> DataFrame:
    """Causal projection: predictions never rise along the life of a unit."""
    return sg.running_min(df, axis, value, name)


# -- value bins ------------------------------------------------------------
def quantile_edges(features: DataFrame, bins: int, group: str = "feature", value: str = "value") -> DataFrame:
    """Cut points per feature: midpoints of neighbours, or of order statistics.

    The features are read once: values are counted per feature, written to the shared
    folder, and ranked from there.  Only the feature sizes, one row for each feature of
    the contract, are shipped to the executors.
    """
    counted = cut_lineage(features.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")))
    sizes = cut_lineage(counted.groupBy(group).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_rows")))
    largest = sizes.agg(F.max("n_distinct")).first()[0] or 0
    sized = counted.join(F.broadcast(sizes), group)
    few = _few(sized.where(F.col("n_distinct") <= bins), group, value)
    if largest <= bins:
        return few
    many = sized.where(F.col("n_distinct") > bins).drop("n_distinct")
    ranked = sg.ranked_values(many, [group], value, whole=largest <= SEGMENT_ROWS)
    return few.unionByName(_many(ranked, group, value, bins))


def _few(few, group, value):
    window = Window.partitionBy(group).orderBy(value)
    return (
        few.withColumn("next", F.lead(value).over(window))
        .withColumn("edge_index", (F.row_number().over(window) - 1).cast("long"))
        .where(F.col("next").isNotNull())
        .select(group, "edge_index", ((F.col(value) + F.col("next")) * 0.5).alias("edge"))
    )


def _many(many, group, value, bins):
    last = F.col("n_rows") - 1
    near = F.greatest(F.floor((F.col("rank_from") - 1) * bins / last), F.lit(1))
    far = F.least(F.ceil((F.col("rank_to") + 1) * bins / last), F.lit(bins - 1))
    step = 100.0 / bins
    targets = F.transform(
        F.sequence(near, far),
        lambda k: F.struct((k - 1).alias("edge_index"), (k * F.lit(step) / 100.0 * last).alias("p")),
    )
    touched = F.filter(
        targets,
        lambda t: (F.ceil(t["p"]) >= F.col("rank_from")) & (F.floor(t["p"]) <= F.col("rank_to")),
    )
    return (
        many.where(near <= far)
        .withColumn("target", F.explode(touched))
        .withColumn("low", F.when(F.floor("target.p").between(F.col("rank_from"), F.col("rank_to")), F.col(value)))
        .withColumn("high", F.when(F.ceil("target.p").between(F.col("rank_from"), F.col("rank_to")), F.col(value)))
        .groupBy(group, F.col("target.edge_index").alias("edge_index"))
        .agg(((F.max("low") + F.max("high")) * 0.5).alias("edge"))
    )


def assign_bins(features: DataFrame, edges: DataFrame, group: str = "feature", value: str = "value") -> DataFrame:
    """Bin of a value: how many cut points lie below it."""
    lists = edges.groupBy(group).agg(F.sort_array(F.collect_list("edge")).alias("__edges"))
    return (
        features.join(F.broadcast(lists), group, "left")
        .withColumn("bin", F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col(value))), F.lit(0)))
        .drop("__edges")
    )
