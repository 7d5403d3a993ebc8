"""Statistics of one channel of a window, as expressions over ``array<double>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lifespan.config import edge_length
from lifespan.fixed_values import STATISTICS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use the result several times in ``body``.

    An expression repeated inside a lambda would run again for every element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def population_std(values: Column, size: int, mean: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / size)


def linear_quantile(ordered: Column, size: int, q: float) -> Column:
    """Quantile of a sorted array by linear interpolation between neighbours."""
    position = q * (size - 1)
    low = int(position)
    high = min(low + 1, size - 1)
    left = F.get(ordered, F.lit(low))
    return left + (F.get(ordered, F.lit(high)) - left) * F.lit(position - low)


def time_axis(length: int) -> list[float]:
    """``length`` evenly spaced positions from -1 to 1."""
    return [-1.0 + 2.0 * i / (length - 1) for i in range(length)] if length > 1 else [-1.0]


def channel_statistics(values: Column, length: int, edge: int | None = None) -> Column:
    """The thirteen statistics of one channel as a struct, in their fixed order."""
    edge = max(1, min(edge if edge is not None else edge_length(length), length))
    axis = time_axis(length)
    norm = sum(t * t for t in axis)
    weights = F.array(*[F.lit(t / norm) for t in axis])

    def body(p: Column) -> Column:
        series, mean, ordered = p["series"], p["mean"], p["ordered"]
        first, last = F.get(series, F.lit(0)), F.get(series, F.lit(length - 1))
        parts = {
            "last": last,
            "first": first,
            "delta": last - first,
            "mean": mean,
            "std": population_std(series, length, mean),
            "min": F.get(ordered, F.lit(0)),
            "max": F.get(ordered, F.lit(length - 1)),
            "q25": linear_quantile(ordered, length, 0.25),
            "q50": linear_quantile(ordered, length, 0.50),
            "q75": linear_quantile(ordered, length, 0.75),
            "slope": total(F.zip_with(series, weights, lambda v, w: v * w)),
            "tail_mean": total(F.slice(series, length - edge + 1, edge)) / edge,
            "head_mean": total(F.slice(series, 1, edge)) / edge,
        }
        return F.struct(*[parts[s].alias(s) for s in STATISTICS])

    prepared = F.struct(
        values.alias("series"),
        (total(values) / length).alias("mean"),
        F.sort_array(values).alias("ordered"),
    )
    return let(prepared, body)


def spread(values: Column, size: int) -> Column:
    """Mean, population std, min and max of a short array as a struct."""

    def body(p: Column) -> Column:
        return F.struct(
            p["mean"].alias("mean"),
            population_std(p["items"], size, p["mean"]).alias("std"),
            F.array_min(p["items"]).alias("min"),
            F.array_max(p["items"]).alias("max"),
        )

    return let(
        values, lambda v: let(F.struct(v.alias("items"), (total(v) / size).alias("mean")), body)
    )
