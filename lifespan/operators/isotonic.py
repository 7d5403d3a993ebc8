"""Non-increasing least-squares projection along the life of a unit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifespan.config import SEGMENT_ROWS
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis
from lifespan.sources.storage import cut_lineage

_POOL = "array<struct<first:bigint,n:bigint,total:double>>"


def _pool(blocks: pd.Series) -> pd.Series:
    """Merge neighbouring blocks until their means no longer rise."""
    out = []
    for items in blocks:
        stack: list[list] = []
        for b in items:
            first, n, total = b["first"], b["n"], b["total"]
            while stack and stack[-1][2] * n < total * stack[-1][1]:
                first, m, s = stack.pop()
                n, total = n + m, total + s
            stack.append([first, n, total])
        out.append([{"first": f, "n": n, "total": s} for f, n, s in stack])
    return pd.Series(out)


def _pool_groups(df: DataFrame, keys: list[str], group) -> DataFrame:
    """Pool the blocks of each series inside slices of bounded size."""
    pool = F.pandas_udf(_pool, _POOL)
    lists = df.groupBy(*keys, group.alias("__slice")).agg(
        F.sort_array(F.collect_list(F.struct("first", "n", "total"))).alias("__b")
    )
    return lists.select(*keys, F.explode(pool("__b")).alias("__p")).select(*keys, "__p.*")


def isotonic_blocks(rows: DataFrame, keys: list[str], slice_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Blocks ``(keys, first, n, total)`` of the projection of ``(keys, position, value)``.

    Pooling neighbours gives the same result in any order.  Slices of a series are
    pooled on their own; while blocks still rise somewhere across a slice border, the
    blocks are numbered again and pooled in slices shifted by half.  No task ever holds
    more than ``slice_rows`` blocks of a series.
    """
    start = rows.select(
        *keys, F.col("position").alias("first"), F.lit(1).cast("long").alias("n"), F.col("value").alias("total")
    )
    blocks = _pool_groups(start, keys, F.floor(F.col("first") / slice_rows))
    axis = Axis(tuple(keys), ("first",), float(slice_rows))
    shift = 0
    while True:
        blocks = cut_lineage(blocks)
        pairs = sg.previous_row(blocks, axis, ["n", "total"], "prev_")
        rising = pairs.where(F.col("prev_total") * F.col("n") < F.col("total") * F.col("prev_n"))
        if rising.isEmpty():
            return blocks
        shift = slice_rows // 2 - shift
        numbered = sg.row_numbers(blocks, axis, "__k")
        blocks = _pool_groups(numbered, keys, F.floor((F.col("__k") + shift) / slice_rows))


def isotonic_nonincreasing(
    df: DataFrame, axis: Axis, value: str, name: str, slice_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Add the projected value; rows are ordered by ``axis`` inside each unit."""
    return project_columns(df, axis, {value: name}, slice_rows)


def project_columns(
    df: DataFrame,
    axis: Axis,
    columns: dict[str, str],
    slice_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Project several value columns of the same rows in one pass.

    Units that fit one slice are projected from one grouped list; only longer units
    take the block route.  An axis of whole units says that all are short; otherwise the
    longest is counted.
    """
    longest = 0
    if not axis.whole_units:
        longest = df.groupBy(*axis.unit).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= slice_rows:
        return _project_short(df, list(axis.order), columns).select(*sg.columns_of(df), *columns.values())
    numbered = sg.row_numbers(df, axis, "__position", "__rows")
    short = _project_short(numbered.where(F.col("__rows") <= slice_rows), ["__position"], columns)
    long = _project_long(numbered.where(F.col("__rows") > slice_rows), axis, columns, slice_rows)
    return short.unionByName(long).select(*sg.columns_of(df), *columns.values())


def _project_short(rows: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    names = list(columns.values())

    @F.pandas_udf(", ".join(f"{n} array<double>" for n in names))
    def fit(*series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: [_fit(np.asarray(v, dtype=float)) for v in s] for n, s in zip(names, series)})

    # the order columns come first and are unique, so they alone decide the order
    keep = [c for c in rows.columns if c not in ("unit_id", *order)]
    packed = F.struct(*[F.col(f"`{c}`") for c in (*order, *keep)])
    lists = rows.groupBy("unit_id").agg(F.sort_array(F.collect_list(packed)).alias("__rows_of_unit"))
    fitted = lists.withColumn("__fit", fit(*[F.col(f"__rows_of_unit.{value}") for value in columns]))
    zipped = fitted.select("unit_id", F.posexplode("__rows_of_unit").alias("__i", "__r"), "__fit")
    return zipped.select("unit_id", "__r.*", *[F.get(f"__fit.{n}", F.col("__i")).alias(n) for n in names])


def _fit(values: np.ndarray) -> np.ndarray:
    sums: list[float] = []
    sizes: list[int] = []
    for v in values:
        s, n = float(v), 1
        while sums and sums[-1] * n < s * sizes[-1]:
            s, n = s + sums.pop(), n + sizes.pop()
        sums.append(s)
        sizes.append(n)
    return np.repeat(np.asarray(sums) / np.asarray(sizes), sizes) if sums else np.empty(0)


def _project_long(rows: DataFrame, axis: Axis, columns: dict[str, str], slice_rows: int) -> DataFrame:
    """All value columns as series of one block run; each block level is then carried forward."""
    series = F.array(*[F.struct(F.lit(n).alias("series"), F.col(v).alias("value")) for v, n in columns.items()])
    stacked = rows.select("unit_id", F.col("__position").alias("position"), F.explode(series).alias("s"))
    blocks = isotonic_blocks(stacked.select("unit_id", "position", "s.*"), ["unit_id", "series"], slice_rows)
    level = F.col("total") / F.col("n")
    marks = blocks.groupBy("unit_id", F.col("first").alias("__position")).agg(
        *[F.max(F.when(F.col("series") == n, level)).alias(f"__level_{n}") for n in columns.values()]
    )
    joined = rows.join(marks, ["unit_id", "__position"], "left")
    by_position = Axis(axis.unit, ("__position",), float(slice_rows))
    out = sg.last_known_columns(joined, by_position, {f"__level_{n}": n for n in columns.values()})
    return out.drop(*[f"__level_{n}" for n in columns.values()])


def projected(df: DataFrame, axis: Axis, value: str, name: str, mode: str, slice_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Projection by mode: none, isotonic_nonincreasing or causal_running_min."""
    if mode == "none":
        return df.withColumn(name, F.col(value))
    if mode == "isotonic_nonincreasing":
        return isotonic_nonincreasing(df, axis, value, name, slice_rows)
    if mode == "causal_running_min":
        return sg.running_min(df, axis, value, name)
    raise ValueError(f"unknown projection {mode}")
