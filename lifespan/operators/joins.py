"""Joins of the telemetry model: references, as-of, versions, lookups."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifespan.config import BROADCAST_ROWS
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table: part of the plan, small by construction and therefore broadcast."""
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("a lookup of this size must be read as a table")
    fields = [part.split() for part in schema.split(",")]
    arrays = [pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)]
    return F.broadcast(spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields])))


def alias_table(spark: SparkSession, groups: dict[str, tuple[str, ...]], key) -> DataFrame:
    """``(alias, canonical)`` from alias groups; ``key`` makes the comparison key in Spark."""
    pairs = [
        (unicodedata.normalize("NFKC", spelling), name)
        for name, spellings in groups.items()
        for spelling in (name, *spellings)
    ]
    raw = dimension(spark, pairs, "spelling string, canonical string")
    return F.broadcast(raw.select(key(F.col("spelling")).alias("alias"), "canonical").distinct())


def ambiguous_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases that stand for two names; must be empty."""
    return aliases.groupBy("alias").agg(F.count_distinct("canonical").alias("n")).where("n > 1")


def resolve_aliases(df: DataFrame, name: str, key: Column, aliases: DataFrame, out: str = "canonical") -> DataFrame:
    """Canonical name of a label, else ``unknown:<label>``."""
    joined = df.withColumn("alias", key).join(aliases.withColumnRenamed("canonical", "__c"), "alias", "left")
    return joined.withColumn(
        out, F.coalesce("__c", F.concat(F.lit("unknown:"), F.trim(name)))
    ).drop("__c", "alias")


def lookup(df: DataFrame, code: str, table: DataFrame, table_code: str, value: str, default: Column) -> DataFrame:
    """Value of a code in a fixed table, else a default."""
    small = table.select(F.col(table_code).alias("__k"), F.col(value).alias(value))
    return df.join(small, F.col(code) == F.col("__k"), "left").withColumn(value, F.coalesce(value, default)).drop("__k")


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the last in ``order`` (unique inside a key); no window over a hot key."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    return rows.groupBy(*key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])


def join_references(
    interval_rows: DataFrame, first: DataFrame, second: DataFrame, order: str, value: str = "y_pred"
) -> DataFrame:
    """Interval rows with the predictions of two reference models on (unit, window)."""
    key = ["unit_id", "window_id"]
    a = keep_last(first, key, order).select(*key, F.col(value).alias("reference_1"))
    b = keep_last(second, key, order).select(*key, F.col(value).alias("reference_2"))
    return interval_rows.join(a, key, "left").join(b, key, "left")


def matched_units(left: DataFrame, right: DataFrame, key: str = "unit_id") -> DataFrame:
    """Rows of units that both sides have."""
    return sg.spread_join(left, right.select(key).distinct(), [key], "left_semi")


def without(left: DataFrame, listed: DataFrame, key: str = "unit_id") -> DataFrame:
    """Rows of units that are not listed (hold-out isolation)."""
    return sg.spread_join(left, listed.select(key).distinct(), [key], "left_anti")


def asof_join(
    telemetry: DataFrame, predictions: DataFrame, t: str, pred_t: str, values: list[str], axis: Axis,
    tie: str = "row_number",
) -> DataFrame:
    """Latest prediction at or before each reading; of equal times the last counts.

    Both sides go on one time axis, cut like ``axis``, and the last prediction is carried
    forward, so neither a busy unit nor a long one has to meet in one task.
    """
    unit = axis.unit[0]
    side = telemetry.select("*", F.col(t).alias("__t"), F.lit(1).alias("__side"), F.col(tie).cast("long").alias("__tie"))
    known = predictions.select(
        unit,
        F.col(pred_t).alias("__t"),
        F.lit(0).alias("__side"),
        F.col(tie).cast("long").alias("__tie"),
        F.struct(F.col(pred_t).alias("matched_t"), *values).alias("__known"),
    )
    both = side.unionByName(known, allowMissingColumns=True)
    merged = axis.ordered_by("__t", "__side", "__tie")
    filled = sg.last_known(both, merged, "__known", "__match").where(F.col("__side") == 1)
    return filled.select(
        *sg.columns_of(telemetry), *[F.col(f"__match.{c}").alias(c) for c in ("matched_t", *values)]
    )


def attach_label(windows: DataFrame, labels: DataFrame, end: str, t: str, label: str) -> DataFrame:
    """Label of the step a window ends at."""
    right = labels.select("unit_id", F.col(t).alias(end), F.col(label).alias("y"))
    return windows.join(right, ["unit_id", end], "left")


def version_state(
    plan: Column, version: Column, active_plan: Column, active_version: Column, roles_valid: Column
) -> Column:
    """current, role-separated, mismatch or unknown."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    known = ~(blank(plan) | blank(version) | blank(active_plan) | blank(active_version))
    same = (plan == active_plan) & (version == active_version)
    return (
        F.when(~known, "unknown")
        .when(same, "current")
        .when(roles_valid & (plan == "B") & (active_plan == "A"), "role-separated")
        .otherwise("mismatch")
    )


def version_compare(samples: DataFrame, active: DataFrame, key: str = "line") -> DataFrame:
    """Compare the table version a sample was made with to the one active for its line.

    ``active`` has one row per product line; whether it is broadcast follows from its size.
    """
    joined = samples.join(active, key, "left")
    return joined.withColumn(
        "state",
        version_state(
            F.col("plan"), F.col("version"), F.col("active_plan"), F.col("active_version"),
            F.coalesce(F.col("roles_valid"), F.lit(False)),
        ),
    )
