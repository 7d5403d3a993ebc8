"""Many small files in one job: columnar tables, binary tables, archives, sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.functions.scalar import design_id
from lifespan.operators import mapping
from lifespan.operators import segments as sg
from lifespan.sources import storage


# -- scans -----------------------------------------------------------------
def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("source", F.input_file_name())


def explode_sample_arrays(df: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """Channel arrays of equal length become one row per sample."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*channels)).alias("sample", "__v")).select(
        *keys, "sample", *[F.col(f"__v.{c}").alias(c) for c in channels]
    )


def suffix(path: Column) -> Column:
    """Lower-case suffix of a file name, with double ones of archives kept whole."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    double = F.regexp_extract(name, r"(\.tar\.(?:gz|bz2|xz))$", 1)
    return F.when(double != "", double).otherwise(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def file_kind(path: Column) -> Column:
    s = suffix(path)
    return (
        F.when(s.isin(*fv.TEXT_SUFFIXES), "text")
        .when(s.isin(*fv.JSON_SUFFIXES), "json")
        .when(s.isin(*fv.COLUMNAR_SUFFIXES), "columnar")
        .when(s.isin(*fv.ARRAY_SUFFIXES), "arrays")
        .when(s.isin(*fv.ARCHIVE_SUFFIXES), "archive")
        .otherwise("unsupported_file_type")
    )


def discover_inputs(files: DataFrame, path: str = "path") -> DataFrame:
    """Which files have a name in the sample grammar; the others are listed, not dropped."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")
    return files.withColumn("stem", stem).withColumn(
        "accepted", design_id(F.col("stem"))["dev"].isNotNull()
    )


def read_small_files(spark: SparkSession, glob: str, max_bytes: int | None = None) -> DataFrame:
    """``(source, length, content)`` of all files; a limit, where one is wanted, is pushed to the scan.

    With a limit ``oversized_files`` names the files left out.
    """
    found = spark.read.format("binaryFile").load(glob)
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)
    return found.select(F.col("path").alias("source"), "length", "content")


def oversized_files(spark: SparkSession, glob: str, max_bytes: int = fv.MAX_FILE_BYTES) -> DataFrame:
    return (
        spark.read.format("binaryFile").load(glob)
        .where(F.col("length") > max_bytes)
        .select(F.col("path").alias("source"), F.lit("file_too_large").alias("code"))
    )


# -- sinks -----------------------------------------------------------------
def guard_output(path: str, protected: list[str]) -> str:
    """Refuse to write below a raw or hold-out root."""
    import posixpath

    target = posixpath.normpath(path)
    for root in protected:
        base = posixpath.normpath(root)
        if target == base or target.startswith(base.rstrip("/") + "/"):
            raise PermissionError(f"writing below {base} is not allowed")
    return path


BUCKET = "__bucket"


def _bucket(unit: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[u.cast("string") for u in unit]), F.lit(buckets)).cast("int")


def write_unit_dataset(
    df: DataFrame, path: str, axis: sg.Axis, protected: list[str] = (), compression: str = "zstd", buckets: int = 64
) -> None:
    """Rows sorted by unit and time in ``buckets`` folders by the hash of the unit, with a Bloom filter on it.

    The number of files follows that of buckets, not of units; rows move by bucket and segment, so a
    very long unit is written by many tasks.  A new version is written beside the old one and becomes
    current when its manifest is; units that are not part of ``df`` are in the old one only, which goes.
    """
    spark = df.sparkSession
    guard_output(path, list(protected))
    store, root = storage.opened(path)
    before = _current(store, root)
    version = uuid.uuid4().hex
    rows = axis.segmented(df).withColumn(BUCKET, _bucket([F.col(u) for u in axis.unit], buckets))
    keys = [k for k in axis.keys if k not in axis.unit]
    writer = (
        rows.repartition(buckets, BUCKET, *keys).sortWithinPartitions(BUCKET, *axis.unit, *keys, *axis.order).drop(sg.SEG)
        .write.partitionBy(BUCKET).option("compression", compression)
    )
    for u in axis.unit:
        writer = writer.option(f"parquet.bloom.filter.enabled#{u}", "true")
    writer.parquet(f"{path}/data/{version}")
    with store.open_output_stream(f"{root}/current.json", compression=None) as out:
        out.write(json.dumps({"version": version, "buckets": buckets, "unit": list(axis.unit)}).encode())
    if before:
        storage.remove(spark, f"{path}/data/{before['version']}")


def _current(store, root: str) -> dict | None:
    try:
        with store.open_input_stream(f"{root}/current.json", compression=None) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def read_unit_dataset(spark: SparkSession, path: str, units: list[tuple] | None = None) -> DataFrame:
    """The current version; with ``units`` (values of the unit columns) only their buckets are read."""
    current = _current(*storage.opened(path))
    if current is None:
        raise FileNotFoundError(f"no dataset at {path}")
    rows = spark.read.parquet(f"{path}/data/{current['version']}")
    if units is None:
        return rows.drop(BUCKET)
    hashed = [_bucket([F.lit(v) for v in unit], current["buckets"]).alias(f"b{i}") for i, unit in enumerate(units)]
    wanted = sorted(set(spark.range(1).select(*hashed).first())) if units else []
    one = lambda unit: sg.all_of([F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(current["unit"], unit)])
    chosen = sg.any_of([one(u) for u in units]) if units else F.lit(False)
    return rows.where(F.col(BUCKET).isin(wanted) & chosen).drop(BUCKET)


def write_predictions(predictions: DataFrame, path: str, protected: list[str] = ()) -> None:
    guard_output(path, list(protected))
    columns = ["window_id", "unit_id", "t_end", "route_id", "prediction", "rul_unit", "truth"]
    predictions.select(*columns).write.mode("overwrite").option("header", True).csv(path)


# fixed values: column order of the flat export
EXPORT_COLUMNS = (
    "filename", "input_sha256", "container_filename", "container_sha256", "archive_member", "line",
    "model_name", "framework", "manifest_sha256", "member_sha256s", "selection_aggregation",
    "production_point_aggregation", "production_point_seed", "interval_member_seeds",
    "uncertainty_mode", "window_index", "time", "time_order", "rul_unit", "y_pred_rul_raw",
    "y_pred_rul", "rul_output_clamped", "p10", "p50", "p90", "ensemble_std",
)


def export_batch(predictions: DataFrame, registry: DataFrame, key: str = "filename") -> DataFrame:
    """One row per prediction with the provenance of its file; lists are joined by ';'."""
    joined = predictions.join(registry, key)
    listed = [c for c, kind in registry.dtypes if kind.startswith("array")]
    for column in listed:
        joined = joined.withColumn(column, F.array_join(F.transform(column, lambda v: v.cast("string")), ";"))
    blank = ["container_filename", "container_sha256", "archive_member", "production_point_seed"]
    for column in blank:
        joined = joined.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))
    return joined.select(*EXPORT_COLUMNS)
