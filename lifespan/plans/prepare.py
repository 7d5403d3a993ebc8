"""Uploaded readings to model windows, with every refusal as a row.

``readings`` is ``(unit_id, time_kind, t, channel, value)``.  Each ``prepare_*`` returns
the steps of units that passed and the violations ``(unit_id, stage, code)`` of the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.config import BATTERY, WHEEL, Contract
from lifespan.functions import scalar as sc
from lifespan.operators import binning, mapping, rules, split
from lifespan.operators.segments import Axis
from lifespan.plans import scoring
from lifespan.sources.storage import written

INDEX_AXIS = Axis(("unit_id",), ("t",), 50_000.0)
BIN_AXIS = Axis(("unit_id",), ("bin",), 50_000.0)
KNOWN_CHANNELS = sorted({*fv.BATTERY_REQUIRED, *fv.WHEEL_CHANNELS, *fv.WHEEL_BASE_CHANNELS})
STAGES = ("parse", "route", "time", "axis", "history")


def _stage(df: DataFrame, stage: str, prefix: str = "") -> DataFrame:
    return df.select(
        F.col("unit_id").cast("string").alias("unit_id"),
        F.lit(STAGES.index(stage)).alias("stage"),
        F.concat(F.lit(prefix), F.col("code")).alias("code"),
    )


def first_codes(violations: DataFrame) -> DataFrame:
    """The code a unit is refused with: the earliest stage wins."""
    return violations.groupBy("unit_id").agg(F.min(F.struct("stage", "code")).alias("v")).select("unit_id", "v.code")


def _collect(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _passed(df: DataFrame, violations: DataFrame) -> DataFrame:
    return rules.valid_units(df.withColumn("unit_id", F.col("unit_id").cast("string")), violations)


def parse_readings(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Text cells ``(unit_id, time_text, channel_text, value_text)`` as typed readings with issues."""
    # times first: in one expression with the values the code of a row is too long to be compiled
    timed = raw.withColumns({"time_kind": sc.time_kind(F.col("time_text")), "t": sc.time_order(F.col("time_text"))})
    typed = timed.select(
        "unit_id",
        "time_kind",
        "t",
        F.trim("channel_text").alias("label"),
        sc.parse_value(F.col("value_text")).alias("value"),
        F.coalesce(
            F.when(F.coalesce(F.trim("time_text"), F.lit("")) == "", "empty_time"),
            F.when(F.col("time_kind").isNull(), "invalid_time"),
            F.when(F.trim("channel_text") == "", "empty_telemetry"),
            F.when(F.char_length(F.trim("channel_text")) > fv.MAX_NAME_LENGTH, "telemetry_name_too_long"),
            sc.value_issue(F.col("value_text")),
        ).alias("issue"),
    )
    return mapping.resolve_channels(spark, typed, "label")


def parse_violations(parsed: DataFrame) -> DataFrame:
    cells = parsed.where("issue is not null").groupBy("unit_id").agg(F.min("issue").alias("code"))
    kinds = parsed.groupBy("unit_id").agg(F.count_distinct("time_kind").alias("n")).where("n > 1").select(
        "unit_id", F.lit("mixed_time_types").alias("code")
    )
    doubled = doubled_cells(parsed).select("unit_id", F.lit("duplicate_observation").alias("code")).distinct()
    return _collect(*[_stage(d, "parse") for d in (cells, kinds, doubled)])


def doubled_cells(parsed: DataFrame) -> DataFrame:
    """Units and times with two readings of one channel.

    At one time the readings of contract channels are compared with the bits of the channels seen, so
    the cells of a step are one row before the exchange.  Other channels are counted by name.
    """
    bit = F.lit(None).cast("int")
    for i, c in enumerate(KNOWN_CHANNELS):
        bit = F.when(F.col("channel") == c, i).otherwise(bit)
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit"))).alias("seen")
    cells = parsed.select("unit_id", "t", "channel", bit.alias("__bit"))
    known = cells.groupBy("unit_id", "t").agg(F.count("__bit").alias("n"), seen).where(F.col("n") > F.bit_count("seen"))
    others = cells.where("__bit is null").groupBy("unit_id", "t", "channel").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.select("unit_id", "t").unionByName(others.select("unit_id", "t"))


def route_units(parsed: DataFrame, requested: str = "auto") -> DataFrame:
    have = split.unit_channels(parsed, KNOWN_CHANNELS)
    return have.select("unit_id", "have", split.route_state(F.col("have"), split.model_routes(), requested).alias("route"))


def route_violations(routes: DataFrame) -> DataFrame:
    failed = routes.where(~F.col("route").isin("battery", "wheel"))
    return _stage(failed.withColumn("code", F.col("route")), "route")


def _history(steps: DataFrame, contract: Contract) -> DataFrame:
    return _stage(rules.history_length(steps, contract.length, contract.stride), "history")


def prepare_battery(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cycle table of a battery: index 0, 1, 2, … and three channels, the fourth absent.

    Steps and violations feed checks and scores, so both are written once.
    """
    required = list(BATTERY.required)
    present = readings.where("channel = 'bat.ir_proxy_ohm'").select(
        "unit_id", F.lit("unsupported_bat_ir_proxy_present").alias("code")
    ).distinct()
    steps = written(mapping.long_to_steps(readings, required))
    violations = written(
        _collect(
            _stage(present, "route"),
            _stage(rules.incomplete_steps(readings, INDEX_AXIS, required), "route"),
            _stage(rules.index_axis(steps, INDEX_AXIS), "axis", "bat_cycle_"),
            _history(steps, BATTERY),
        )
    )
    ready = _passed(steps, violations).select(
        "unit_id",
        F.round("t").cast("long").alias("step"),
        "t",
        F.col("t").alias("age"),
        *[F.col(f"`{c}`").alias(short(c)) if c in required else F.lit(0.0).alias(short(c)) for c in BATTERY.channels],
    )
    return ready, violations


def prepare_wheel_bins(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Already aggregated wheel features, one row per bin index."""
    channels = list(WHEEL.channels)
    steps = mapping.long_to_steps(readings, channels)
    violations = _collect(
        _stage(rules.incomplete_steps(readings, INDEX_AXIS, channels), "route"),
        _stage(rules.index_axis(steps, INDEX_AXIS), "axis", "rwa_feature_bin_"),
        _history(steps, WHEEL),
    )
    ready = _passed(steps, violations).select(
        "unit_id",
        F.round("t").cast("long").alias("step"),
        "t",
        sc.bin_age_days(F.round("t")).alias("age"),
        *[F.col(f"`{c}`").alias(short(c)) for c in channels],
    )
    return ready, violations


def prepare_wheel_raw(
    readings: DataFrame, time_unit: str, intercept: float, slope: float, width: float = fv.BIN_WIDTH_S
) -> tuple[DataFrame, DataFrame]:
    """Raw wheel telemetry aggregated to bins, with the friction feature."""
    base = list(fv.WHEEL_BASE_CHANNELS)
    used = readings.where(F.col("channel").isin(*base))
    clock = used.where("time_kind <> 'numeric'").select("unit_id", F.lit("rwa_bin_phase_undefined").alias("code")).distinct()
    in_seconds = used.withColumn("s", sc.to_seconds(F.col("t"), F.lit(time_unit)))
    bins = binning.bin_aggregate(in_seconds, base, width, t="s")
    have = F.array_compact(F.array(*[F.when(F.col(f"`{c}.n`") > 0, F.lit(c)) for c in base]))
    axis = rules.bin_axis(bins.select("unit_id", "bin", have.alias("have")), BIN_AXIS, base)
    code = (
        F.when(F.col("n_negative") > 0, "rwa_raw_time_negative")
        .when(F.col("first_bin") != 0, "rwa_raw_time_origin")
        .when(F.col("first_missing_bin").isNotNull(), "rwa_time_gap")
        .when(F.col("n_incomplete") > 0, "incomplete_rwa_bin")
    )
    violations = _collect(
        _stage(clock, "time"),
        _stage(axis.withColumn("code", code).where("code is not null"), "axis"),
        _history(bins, WHEEL),
    )
    friction = sc.friction_feature(
        F.col("`rw.motor_current_a.mean`"), F.col("`rw.bearing_temp_c.mean`"), F.lit(intercept), F.lit(slope)
    )
    ready = _passed(bins.withColumn(fv.WHEEL_FRICTION, friction), violations).select(
        "unit_id",
        F.col("bin").alias("step"),
        F.col("t_end").alias("t"),
        (F.col("t_end") / 86400.0).alias("age"),
        *[F.col(f"`{c}`").alias(short(c)) for c in WHEEL.channels],
    )
    return ready, violations


def battery_upload(spark: SparkSession, raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text cells of battery units to their readings, the steps of units that passed, and every refusal.

    Cells are read for their labels and for their values, and the typed readings and the refusals feed
    every check, so each of them is written once.
    """
    parsed = written(parse_readings(spark, written(raw)))
    routes = route_units(parsed, "battery")
    refused = written(parse_violations(parsed).unionByName(route_violations(routes)))
    steps, violations = prepare_battery(rules.valid_units(parsed, refused))
    return parsed, steps, refused.unionByName(violations)


def short(channel: str) -> str:
    """Column name of a channel (dots are awkward in Spark column names)."""
    return channel.replace(".", "_")


def scoring_plan(contract: Contract) -> scoring.ScoringPlan:
    return scoring.ScoringPlan(
        channels=tuple(short(c) for c in contract.channels),
        length=contract.length,
        stride=contract.stride,
        rmax=contract.rmax,
        age_threshold=contract.age_threshold,
        low_weight=contract.low_weight,
        high_weight=contract.high_weight,
    )


def file_status(units: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per submitted unit: whether it was predicted, and the code if not."""
    codes = first_codes(violations)
    ids = units.select(F.col("unit_id").cast("string").alias("unit_id")).distinct()
    return ids.join(codes, "unit_id", "left").withColumn("predicted", F.col("code").isNull())
