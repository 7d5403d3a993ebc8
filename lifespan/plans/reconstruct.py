"""Simulation samples to interim tables: explode, check, rebuild cycles, register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.operators import binning, rules
from lifespan.operators.segments import Axis
from lifespan.sources.files import explode_sample_arrays

SAMPLE_AXIS = Axis(("unit_id",), ("t",), 86_400.0)


def explode_samples(samples: DataFrame, channels: list[str]) -> DataFrame:
    """Arrays per unit to one row per 10 s sample; ``t`` in seconds from ``t_days``."""
    rows = explode_sample_arrays(samples, ["t_days", *channels], ["unit_id"])
    return rows.withColumn("t", F.round(F.col("t_days") * 86400.0, 6))


def sample_violations(rows: DataFrame) -> DataFrame:
    """Codes of units whose grid, truth or labels break the sample contract."""
    grid = rules.sample_grid(rows, SAMPLE_AXIS, fv.SAMPLE_PERIOD_S)
    mono = rules.monotone(rows, SAMPLE_AXIS, {"fail": 0.0}, {"soh": 1e-9})
    ident = rules.sample_identities(rows)
    joined = grid.join(mono, "unit_id").join(ident, "unit_id")
    code = (
        F.when((F.col("n_not_rising") > 0) | (F.col("n_off_grid") > 0) | ~F.col("starts_at_zero"), "time_grid")
        .when((F.col("fail_breaks") > 0) | (F.col("hi_range") > 0), "labels")
        .when((F.col("soh_breaks") > 0) | (F.col("lli") > 0) | (F.col("lam") > 0) | (F.col("cycle_index") > 0), "truth")
    )
    return joined.select("unit_id", code.alias("code")).where("code is not null")


def battery_cycles(rows: DataFrame, q0: float = fv.NOMINAL_CAPACITY_AH) -> DataFrame:
    """Labelled cycle table of battery samples."""
    samples = rows.select("unit_id", "t", "current", "temp", "soh", "hi")
    cycles = binning.reconstruct_cycles(samples, fv.ORBIT_PERIOD_S, fv.SAMPLE_PERIOD_S, q0)
    return binning.failure_cycle(cycles, q0)
