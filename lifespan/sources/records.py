"""JSON telemetry: one object per line, or an array of objects or of rows per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifespan.operators import segments as sg
from lifespan.sources.files import read_small_files


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One raw object per non-empty line with its file."""
    lines = spark.read.text(path).withColumn("source", F.input_file_name())
    kept = lines.where(F.trim("value") != "").withColumnRenamed("value", "record")
    return kept.withColumn("record_id", F.monotonically_increasing_id())


def read_json_arrays(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Elements of the top-level array of each file; a header row makes objects of the rest.

    A file is one value here; with a limit, files over it are left to ``oversized_files``.
    """
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\\ufeff", "")
    small = read_small_files(spark, path, max_bytes)
    items = small.select("source", F.from_json(text, "array<string>").alias("items"))
    first = F.get("items", F.lit(0))
    header = F.from_json(first, "array<string>")
    from_rows = F.transform(
        F.slice("items", 2, F.greatest(F.size("items"), F.lit(0))),
        lambda r: F.to_json(F.map_from_arrays(header, F.from_json(r, "array<string>"))),
    )
    records = F.when(first.startswith("["), from_rows).otherwise(F.col("items"))
    each = items.select("source", F.explode_outer(records).alias("record"))
    return each.withColumn("record_id", F.monotonically_increasing_id())


def record_issues(records: DataFrame) -> DataFrame:
    """Per source: records that are no object, repeat a key, or have another key set."""
    keys = F.json_object_keys("record")
    marked = records.select(
        "source",
        keys.alias("keys"),
        (F.size(keys) != F.size(F.array_distinct(keys))).alias("repeated"),
    )
    per = marked.groupBy("source").agg(
        F.count_if(F.col("keys").isNull()).alias("not_objects"),
        F.count_if("repeated").alias("repeated"),
        F.count_distinct(F.array_sort("keys")).alias("shapes"),
    )
    code = (
        F.when(F.col("not_objects") > 0, "json_layout_required")
        .when(F.col("repeated") > 0, "duplicate_json_key")
        .when(F.col("shapes") > 1, "json_record_shape")
    )
    return per.select("source", code.alias("code")).where("code is not null")


def read_json_records(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(source, column, text)`` cells of sound files and the issues of the others."""
    records = read_json_lines(spark, path) if lines else read_json_arrays(spark, path)
    return record_cells(records), record_issues(records)


def record_cells(records: DataFrame) -> DataFrame:
    # one file may hold most records, so the rows of a file are spread over the join
    sound = sg.spread_join(records, record_issues(records).select("source"), ["source"], "left_anti")
    cells = F.from_json("record", "map<string,string>")
    return sound.select("source", "record_id", F.explode(cells).alias("column", "text"))
