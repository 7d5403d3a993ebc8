"""Splits, samples and routing of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan.config import CONTRACTS
from lifespan import fixed_values as fv
from lifespan.operators import segments as sg


def digest(seed: int, unit: str = "unit_id") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string")), 256)


def cell_tail_split(
    units: DataFrame, cell: str, val_frac: float, seed: int, holdout: DataFrame | None = None
) -> DataFrame:
    """Per design cell the units with the largest digests become validation units.

    At least one and at most all but one unit of a cell; a single unit trains.  Units
    on the hold-out list are set aside before the cells are counted.
    """
    held = F.lit(False)
    marked = units
    if holdout is not None:
        listed = holdout.select("unit_id").distinct().withColumn("__listed", F.lit(True))
        marked = units.join(listed, "unit_id", "left")
        held = F.col("__listed").isNotNull()
    marked = marked.select("unit_id", cell, held.alias("__held"), digest(seed).alias("__d"))
    ranked = sg.rank_by_hash(marked, [cell, "__held"], "__d", "__r", "__n")
    n_val = F.when(F.col("__n") == 1, 0).otherwise(
        F.greatest(F.lit(1), F.least(F.floor(F.col("__n") * F.lit(val_frac)), F.col("__n") - 1))
    )
    part = (
        F.when(F.col("__held"), "holdout")
        .when(F.col("__r") >= F.col("__n") - n_val, "val")
        .otherwise("train")
    )
    return ranked.select("unit_id", cell, part.alias("split"))


def split_differences(computed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows that are only in the computed or only in the recorded split."""
    columns = computed.columns
    return (
        computed.exceptAll(recorded.select(*columns)).withColumn("only_in", F.lit("computed"))
        .unionByName(recorded.select(*columns).exceptAll(computed).withColumn("only_in", F.lit("recorded")))
    )


def sample_rows(df: DataFrame, maximum: int, seed: int, key: str) -> DataFrame:
    """Repeatable sample without replacement; everything when there are few rows.

    Each partition keeps its ``maximum`` smallest digests, and only those meet.
    """
    return df.orderBy(digest(seed, key), key).limit(maximum)


def unit_channels(readings: DataFrame, channels: list[str]) -> DataFrame:
    """Which of the contract channels a unit has (bounded by the contracts)."""
    flags = sg.value_flags("channel", channels)
    return readings.groupBy("unit_id").agg(*flags).select("unit_id", sg.flagged(channels).alias("have"))


def route_state(have: Column, routes: dict[str, list[list[str]]], requested: str = "auto") -> Column:
    """Contract a unit meets, or the code of why none was chosen.

    ``routes`` maps a contract name to its alternative lists of required channels.
    """
    def meets(groups):
        return sg.any_of([F.size(F.array_except(F.array(*[F.lit(c) for c in g]), have)) == 0 for g in groups])

    hits = F.filter(
        F.array(*[F.when(meets(groups), F.lit(name)) for name, groups in routes.items()]),
        lambda r: r.isNotNull(),
    )
    only = F.get(hits, F.lit(0))
    chosen = F.when(F.array_contains(hits, requested), F.lit(requested))
    return (
        F.when(F.size(hits) == 0, "unsupported_telemetry_set")
        .when(F.size(hits) > 1, F.coalesce(chosen, F.lit("ambiguous_product_line")))
        .when((F.lit(requested) != "auto") & (only != requested), "line_mismatch")
        .otherwise(only)
    )


def model_routes() -> dict[str, list[list[str]]]:
    return {
        "battery": [list(CONTRACTS["battery"].required)],
        "wheel": [list(fv.WHEEL_CHANNELS), list(fv.WHEEL_BASE_CHANNELS)],
    }


def ignored_channels(readings: DataFrame, used: list[str]) -> DataFrame:
    """Channels of a unit outside its contract, one row each."""
    return readings.where(~F.col("channel").isin(*used)).select("unit_id", "channel").distinct()
