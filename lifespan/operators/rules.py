"""Validation rules.  Each one is a query that yields violation rows.

A violation row is ``(unit_id, code, details)``; a unit with any row is left out of
scoring.  Rules on order use segment-wise neighbours, so long units stay split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.functions import scalar as sc
from lifespan.operators import mapping
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis


def violation(unit: Column, code: str, details: Column) -> list[Column]:
    return [unit.alias("unit_id"), F.lit(code).alias("code"), details.cast("string").alias("details")]


def _found(df: DataFrame, code: str, details: Column, unit: str = "unit_id") -> DataFrame:
    return df.select(*violation(F.col(unit), code, details))


def collect(*rules: DataFrame) -> DataFrame:
    """All violations as one table."""
    return reduce(DataFrame.unionByName, rules)


def valid_units(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of units without any violation."""
    return sg.spread_join(df, violations.select("unit_id").distinct(), ["unit_id"], "left_anti")


# -- readings --------------------------------------------------------------
def duplicate_observations(readings: DataFrame, key: list[str]) -> DataFrame:
    dup = readings.groupBy("unit_id", *key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(dup, "duplicate_observation", F.concat_ws("|", *[F.col(k).cast("string") for k in key], "n"))


def mixed_time_kinds(readings: DataFrame, kind: str = "time_kind") -> DataFrame:
    kinds = readings.groupBy("unit_id").agg(F.count_distinct(kind).alias("n"))
    return _found(kinds.where("n > 1"), "mixed_time_types", F.col("n"))


def multiple_components(readings: DataFrame, component: str) -> DataFrame:
    named = readings.where(F.coalesce(F.trim(component), F.lit("")) != "")
    ids = named.groupBy("unit_id").agg(F.count_distinct(F.trim(component)).alias("n"))
    return _found(ids.where("n > 1"), "multiple_component_ids", F.col("n"))


def inconsistent_units(declared: DataFrame) -> DataFrame:
    """``declared`` is ``(unit_id, channel, declared_unit)``: one unit per channel only."""
    seen = declared.where("declared_unit is not null").groupBy("unit_id", "channel").agg(
        F.count_distinct("declared_unit").alias("n")
    )
    return _found(seen.where("n > 1"), "inconsistent_channel_unit", F.col("channel"))


def unit_mismatch(declared: DataFrame, expected: DataFrame, aliases: DataFrame) -> DataFrame:
    """Declared units that are not a same-scale spelling of the expected one.

    ``expected (channel, expected_unit)`` and ``aliases (alias, canonical)`` come from the
    fixed unit tables.
    """
    seen = declared.where("declared_unit is not null").select("unit_id", "channel", "declared_unit").distinct()
    named = (
        mapping.with_nfkc(seen, "declared_unit", "plain")
        .withColumn("alias", sc.name_key(F.col("plain")))
        .join(F.broadcast(expected), "channel")
        .join(F.broadcast(aliases), "alias", "left")
    )
    wrong = named.where(~F.col("canonical").eqNullSafe(F.col("expected_unit")))
    return _found(wrong, "model_channel_unit_mismatch", F.concat_ws("|", "channel", "declared_unit"))


def ambiguous_wide_unit(columns: DataFrame) -> DataFrame:
    """Wide files with one unit column but several channel columns (``source, semantic``)."""
    per = columns.groupBy("source").agg(
        F.count_if(F.col("semantic") == "unit").alias("u"), F.count_if(F.col("semantic") == "channel").alias("c")
    )
    return _found(per.where("u > 0 and c > 1"), "ambiguous_wide_unit", F.col("c"), "source")


def incomplete_steps(readings: DataFrame, axis: Axis, required: list[str], examples: int = 5) -> DataFrame:
    """Units with steps that lack a required channel: how many, and the first few."""
    t = axis.order[0]
    need = sorted({*required})
    steps = (
        readings.where(F.col("channel").isin(*required))
        .groupBy("unit_id", t)
        .agg(*sg.value_flags("channel", need))
        .select("unit_id", t, sg.flagged(need, present=False).alias("missing"))
        .where(F.size("missing") > 0)
    )
    numbered = sg.row_numbers(steps, axis, "position", "n_steps").where(F.col("position") < examples)
    return (
        numbered.groupBy("unit_id")
        .agg(
            F.max("n_steps").alias("n_steps"),
            F.sort_array(F.collect_list(F.struct(t, "missing"))).alias("examples"),
        )
        .withColumn("code", F.lit("incomplete_time_steps"))
    )


def index_axis(steps: DataFrame, axis: Axis, index: str = "t") -> DataFrame:
    """Index must be 0, 1, 2, …: one row per unit and kind of fault."""
    i = F.col(index)
    pairs = sg.previous_row(steps, axis, [index], "prev_")
    whole = F.round(i)
    gap = F.col(f"prev_{index}").isNotNull() & (whole != F.round(f"prev_{index}") + 1)
    faults = pairs.groupBy(*axis.unit).agg(
        F.count_if(F.abs(i - whole) > 1e-9).alias("not_integer"),
        F.count_if(whole < 0).alias("negative"),
        F.min(whole).alias("first"),
        F.count_if(gap).alias("gaps"),
        F.min(F.when(gap, F.round(f"prev_{index}") + 1)).alias("missing_from"),
    )
    return faults.select(
        F.col(axis.unit[0]).alias("unit_id"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("index_not_integer").alias("code"), F.when(F.col("not_integer") > 0, F.col("not_integer").cast("double")).alias("detail")),
                    F.struct(F.lit("index_negative").alias("code"), F.when(F.col("negative") > 0, F.col("negative").cast("double")).alias("detail")),
                    F.struct(F.lit("index_origin").alias("code"), F.when(F.col("first") != 0, F.col("first")).alias("detail")),
                    F.struct(F.lit("time_gap").alias("code"), F.col("missing_from").alias("detail")),
                ),
                # no fault, no detail; the first missing index may be 0
                lambda s: s["detail"].isNotNull(),
            )
        ).alias("v"),
    ).select("unit_id", "v.code", "v.detail")


def bin_axis(bins: DataFrame, axis: Axis, required: list[str]) -> DataFrame:
    """Bins must start at 0, have no hole, and hold every required channel.

    ``bins`` is ``(unit_id, bin, have)`` with the set of channels seen in the bin.
    """
    need = F.array(*[F.lit(c) for c in sorted(required)])
    pairs = sg.previous_row(bins, axis, ["bin"], "prev_")
    hole = F.col("prev_bin").isNotNull() & (F.col("bin") != F.col("prev_bin") + 1)
    short = F.size(F.array_except(need, F.col("have"))) > 0
    return pairs.groupBy("unit_id").agg(
        F.count_if(F.col("bin") < 0).alias("n_negative"),
        F.min("bin").alias("first_bin"),
        F.min(F.when(hole, F.col("prev_bin") + 1)).alias("first_missing_bin"),
        F.count_if(short).alias("n_incomplete"),
        F.min(F.when(short, F.col("bin"))).alias("first_incomplete"),
    )


def history_length(steps: DataFrame, length: int, stride: int, max_windows: int | None = None) -> DataFrame:
    """Units with too short a history; with ``max_windows`` also those with more windows than that."""
    from lifespan.operators.windows import window_count

    n = steps.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
    short = _found(n.where(F.col("n") < length), "insufficient_history", F.col("n"))
    if max_windows is None:
        return short
    return collect(
        short,
        _found(
            n.where(window_count(F.col("n"), length, stride) > max_windows),
            "too_many_windows",
            window_count(F.col("n"), length, stride),
        ),
    )


def name_rules(readings: DataFrame, name: str = "channel_text", max_length: int = fv.MAX_NAME_LENGTH) -> DataFrame:
    text = F.trim(F.coalesce(F.col(name), F.lit("")))
    code = F.when(text == "", "empty_telemetry").when(F.char_length(text) > max_length, "telemetry_name_too_long")
    return readings.withColumn("code", code).where("code is not null")


def empty_wide_rows(wide: DataFrame, channels: list[str]) -> DataFrame:
    """Rows of a wide table without any value."""
    blank = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in channels]
    return wide.where(sg.all_of(blank)).withColumn("code", F.lit("empty_wide_observation"))


def row_width(cells: DataFrame, expected: int, cell_array: str = "cells") -> DataFrame:
    return cells.where(F.size(cell_array) != expected).withColumn("code", F.lit("row_column_count"))


def size_caps(
    files: DataFrame,
    max_files: int = fv.MAX_FILES,
    max_bytes: int = fv.MAX_FILE_BYTES,
    max_total: int = fv.MAX_TOTAL_BYTES,
    max_columns: int = fv.MAX_COLUMNS,
    max_records: int = fv.MAX_RECORDS_PER_FILE,
) -> DataFrame:
    """``files`` is ``(batch, source, bytes, n_columns, n_records)``; caps per file and batch."""
    single = files.select(
        "batch",
        "source",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("bytes") > max_bytes, F.lit("file_too_large")),
                    F.when((F.col("n_columns") < 2) | (F.col("n_columns") > max_columns), F.lit("telemetry_table_columns_required")),
                    F.when(F.col("n_records") > max_records, F.lit("too_many_records")),
                ),
                lambda c: c.isNotNull(),
            )
        ).alias("code"),
    )
    totals = files.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    whole = totals.select(
        "batch",
        F.lit(None).cast("string").alias("source"),
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("n") > max_files, F.lit("too_many_files")),
                    F.when(F.col("b") > max_total, F.lit("batch_too_large")),
                ),
                lambda c: c.isNotNull(),
            )
        ).alias("code"),
    )
    return single.unionByName(whole)


# -- simulated samples -----------------------------------------------------
def sample_grid(samples: DataFrame, axis: Axis, period: float, tolerance: float = 1e-6) -> DataFrame:
    """Time must rise, start at 0 and keep a uniform period; counts per unit."""
    t = axis.order[0]
    pairs = sg.previous_row(samples, axis, [t], "prev_")
    step = F.col(t) - F.col(f"prev_{t}")
    return pairs.groupBy(*axis.unit).agg(
        F.count_if(step <= 0).alias("n_not_rising"),
        F.count_if(F.abs(step - period) > tolerance).alias("n_off_grid"),
        (F.abs(F.min(t)) < 1e-12).alias("starts_at_zero"),
    )


def finite_and_aligned(readings: DataFrame, channels: list[str]) -> DataFrame:
    """Value count and non-finite count of every channel, and whether counts agree."""
    counts = []
    for c in channels:
        v = F.col("channel") == c
        counts += [
            F.count_if(v).alias(f"n_{c}"),
            F.count_if(v & ~sc.finite(F.col("value"))).alias(f"bad_{c}"),
        ]
    out = readings.groupBy("unit_id").agg(*counts)
    same = sg.all_of([F.col(f"n_{c}") == F.col(f"n_{channels[0]}") for c in channels])
    return out.withColumn("aligned", same)


def monotone(df: DataFrame, axis: Axis, rising: dict[str, float], falling: dict[str, float]) -> DataFrame:
    """Counts of steps that break a rising or falling column by more than its tolerance."""
    columns = [*rising, *falling]
    pairs = sg.previous_row(df, axis, columns, "prev_")
    checks = [F.count_if(F.col(c) - F.col(f"prev_{c}") < -tol).alias(f"{c}_breaks") for c, tol in rising.items()]
    checks += [F.count_if(F.col(c) - F.col(f"prev_{c}") > tol).alias(f"{c}_breaks") for c, tol in falling.items()]
    return pairs.groupBy(*axis.unit).agg(*checks)


def label_identity(rows: DataFrame) -> DataFrame:
    """``rul`` must equal failure time minus time; censored units have neither label.

    ``rows`` is ``(unit_id, t, rul, fail, failure_time)``.
    """
    gap = F.abs(F.col("rul") - (F.col("failure_time") - F.col("t")))
    return rows.groupBy("unit_id").agg(
        F.max(gap).alias("max_gap"),
        (F.coalesce(F.max(gap), F.lit(0.0)) <= fv.LABEL_ATOL).alias("carried"),
        (F.coalesce(F.max(gap), F.lit(0.0)) <= fv.LABEL_STRICT_TOL).alias("strict"),
        (
            F.max("failure_time").isNotNull()
            | ((F.count("rul") == 0) & (F.coalesce(F.max("fail"), F.lit(0)) == 0))
        ).alias("censoring_ok"),
    )


def sample_identities(rows: DataFrame, period: float = fv.ORBIT_PERIOD_S) -> DataFrame:
    """Counts of rows that break the range or the identity of a derived column.

    ``rows`` is ``(unit_id, t, cycle_index, hi, soh, lli, lam)`` with ``t`` in seconds.
    """
    expected = F.floor(F.col("t") / F.lit(period) + 1e-9)
    return rows.groupBy("unit_id").agg(
        F.count_if((F.col("hi") < -1e-6) | (F.col("hi") > fv.HEALTH_INDEX_MAX + 1e-9)).alias("hi_range"),
        F.count_if(F.col("cycle_index") != expected).alias("cycle_index"),
        F.count_if(F.abs(F.col("lli") - (1.0 - F.col("soh"))) > 2e-6).alias("lli"),
        F.count_if(F.abs("lam") > 2e-6).alias("lam"),
    )


def unknown_codes(rows: DataFrame, code: str, known: list[int]) -> DataFrame:
    return rows.where(F.col(code).isNull() | ~F.col(code).isin(*known))


def metadata_agrees(rows: DataFrame, fields: list[str], document: str = "meta_json") -> DataFrame:
    """Rows whose metadata fields are blank or differ from the JSON copy; names the fields."""
    wrong = F.filter(
        F.array(
            *[
                F.when(
                    (F.coalesce(F.col(f).cast("string"), F.lit("")) == "")
                    | ~F.get_json_object(document, f"$.{f}").eqNullSafe(F.col(f).cast("string")),
                    F.lit(f),
                )
                for f in fields
            ]
        ),
        lambda f: f.isNotNull(),
    )
    return rows.withColumn("differing", wrong).where(F.size("differing") > 0)


def exact_attributes(names: Column, expected=fv.LABEL_ATTRIBUTES) -> Column:
    """True when an array of attribute names is exactly the expected set."""
    return F.array_sort(F.array_distinct(names)) == F.array(*[F.lit(n) for n in sorted(expected)])


# -- splits, contracts, predictions ------------------------------------------
def split_overlap(train: DataFrame, val: DataFrame) -> DataFrame:
    """Units found on both sides, all of them."""
    return train.select("unit_id").distinct().join(val.select("unit_id").distinct(), "unit_id", "left_semi")


def holdout_leaks(used: DataFrame, holdout: DataFrame) -> DataFrame:
    """Used units that are on the hold-out list; an empty list is an error."""
    holdout = require_rows(holdout, "the hold-out list")
    return used.select("unit_id").distinct().join(holdout.select("unit_id").distinct(), "unit_id", "left_semi")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """An empty list is an error, not a pass."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def prediction_quality(rows: DataFrame) -> DataFrame:
    """Invalid, foreign, crossed, unmatched and clamped rows, counted in one pass."""
    named = (F.coalesce(F.col("unit_id").cast("string"), F.lit("")) != "") & (
        F.coalesce(F.col("window_id").cast("string"), F.lit("")) != ""
    )
    inside = named & (F.col("split") == "holdout")
    whole = sg.all_of([sc.finite(F.col(c)) for c in ("t_end", "y_true", "p10", "p50", "p90")])
    ok = inside & whole
    crossed = (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90"))
    return rows.agg(
        F.count_if(~named | (inside & ~whole)).alias("invalid_rows"),
        F.count_if(named & ~F.coalesce(F.col("split") == "holdout", F.lit(False))).alias("non_holdout_rows"),
        F.count_if(ok & crossed).alias("quantile_crossings"),
        F.count_if(ok & F.col("reference_1").isNull()).alias("missing_reference_1"),
        F.count_if(ok & F.col("reference_2").isNull()).alias("missing_reference_2"),
        F.count_if(ok & F.coalesce(F.col("clamped"), F.lit(False))).alias("clamped_rows"),
    )


def window_shape(windows: DataFrame, length: int, channels: int) -> DataFrame:
    good = (F.size("x") == length) & F.forall("x", lambda row: F.size(row) == channels)
    return windows.where(~good).withColumn("code", F.lit("model_shape_mismatch"))


def contract_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key the fields in which two contract records differ."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    diff = F.filter(
        F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]),
        lambda f: f.isNotNull(),
    )
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.array_join(diff, ",").alias("differing"))


def seed_contract(entries: DataFrame, expected=fv.MEMBER_SEEDS) -> DataFrame:
    """Per component: exactly the expected seeds, each once, with 64-digit digests."""
    want = F.array(*[F.lit(s) for s in sorted(expected)])
    return entries.groupBy("component").agg(
        (
            (F.count_distinct("seed") == len(expected))
            & (F.count_distinct(F.when(F.col("seed").isin(*expected), F.col("seed"))) == F.size(want))
            & (F.count(F.lit(1)) == len(expected))
        ).alias("seeds_ok"),
        F.bool_and(F.col("digest").rlike("^[0-9a-f]{64}$")).alias("digests_ok"),
    )
