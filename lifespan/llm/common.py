"""Small helpers that the training-data operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lifespan.sources.storage import checkpoint_folder, cut_lineage

#: White space that separates words: space and the ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder; work goes on from there."""
    return cut_lineage(df)


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and keeps for its later tasks.

    The package travels to workers by value, so a cache in one of its modules would end with the
    task; a module entry of the process stays.
    """
    held = sys.modules.setdefault("lifespan_worker_values", types.ModuleType("lifespan_worker_values")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def documents(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row in the whole order, without one task holding all rows.

    Rows are cut by range and sorted inside each cut; only the row counts of the cuts, as many as
    there are shuffle partitions, meet in one place.
    """
    part, local, before, n = free_names(df, "part__", "local__", "before__", "n__")
    cuts = partitions_of(df.sparkSession)
    placed = cut(df.repartitionByRange(cuts, *order).withColumn(part, F.spark_partition_id()))
    counted = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    running = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(part, F.coalesce(F.sum(n).over(running), F.lit(0)).alias(before))
    numbered = placed.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    joined = numbered.join(F.broadcast(offsets), part)
    return joined.select(*df.columns, (F.col(before) + F.col(local) - 1).alias(name))


def pieces_of(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose text is about ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [len(v) if v is not None else 0 for v in map(_bytes, batch.column(column))]
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def _bytes(scalar: pa.Scalar):
    return scalar.as_buffer() if scalar.is_valid else None
