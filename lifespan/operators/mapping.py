"""From uploaded tables to long telemetry: headers, layouts, units, steps."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lifespan import fixed_values as fv
from lifespan.functions import scalar as sc
from lifespan.operators import joins
from lifespan.operators import segments as sg


def with_nfkc(df: DataFrame, column: str, out: str) -> DataFrame:
    """Compatibility-normalised text.  Python sees each distinct spelling once."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    names = df.select(column).distinct().withColumn(out, nfkc(F.col(column)))
    return sg.spread_join(df, names, [column], "left")


def normalise_names(df: DataFrame, column: str, out: str, strict: bool = False) -> DataFrame:
    """Comparison key of a name; ``strict`` keeps separators and brackets."""
    key = sc.header_key if strict else sc.name_key
    return with_nfkc(df, column, "__nfkc").withColumn(out, key(F.col("__nfkc"))).drop("__nfkc")


def header_aliases(spark: SparkSession) -> DataFrame:
    return joins.alias_table(spark, fv.HEADER_ALIASES, sc.header_key)


def metadata_aliases(spark: SparkSession) -> DataFrame:
    return joins.alias_table(spark, fv.METADATA_ALIASES, sc.header_key)


def channel_aliases(spark: SparkSession) -> DataFrame:
    return joins.alias_table(spark, fv.CHANNEL_ALIASES, sc.name_key)


def resolve_channels(spark: SparkSession, df: DataFrame, label: str, out: str = "channel") -> DataFrame:
    """Canonical channel of a label, compared in compatibility form, else ``unknown:<label>``.

    The table of distinct labels is written once, since readings are used many times after this; its
    known size lets Spark broadcast it where it is small and shuffle it where it is not.
    """
    from lifespan.sources.storage import checkpoint_folder, cut_lineage

    path = f"{checkpoint_folder(spark).rstrip('/')}/labels-{uuid.uuid4().hex}"
    plain = with_nfkc(cut_lineage(df.select(label).distinct()), label, "__plain")
    named = joins.resolve_aliases(plain, label, sc.name_key(F.col("__plain")), channel_aliases(spark), out)
    named.where(F.col(label).isNotNull()).select(label, out).write.parquet(path)
    return df.join(spark.read.parquet(path), label, "left")


def file_headers(spark: SparkSession, file_columns: DataFrame) -> DataFrame:
    """Meaning of every column of many files: role, canonical name and time unit hint."""
    hints = joins.dimension(
        spark,
        [(alias, unit) for unit, group in fv.TIME_UNIT_HEADERS.items() for alias in group],
        "hint_alias string, time_hint string",
    )
    plain = with_nfkc(file_columns, "column", "__plain")
    keyed = plain.withColumns(
        {"header_key": sc.header_key(F.col("__plain")), "channel_key": sc.name_key(F.col("__plain"))}
    ).drop("__plain")
    head = header_aliases(spark).toDF("header_key", "semantic")
    meta = metadata_aliases(spark).toDF("header_key", "metadata")
    chan = channel_aliases(spark).toDF("channel_key", "channel")
    return (
        keyed.join(head, "header_key", "left")
        .join(meta, "header_key", "left")
        .join(chan, "channel_key", "left")
        .join(hints.withColumnRenamed("hint_alias", "header_key"), "header_key", "left")
    )


def detect_layout(headers: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Per source: long, wide, or the code of the first fault; more columns than ``max_columns`` are one, where it is given."""
    # the meanings follow from the key, so they can be grouping columns
    named = headers.groupBy("source", "header_key", "semantic", "metadata", "channel").agg(
        F.count(F.lit(1)).alias("same_key"),
        F.max(F.coalesce(F.trim("column"), F.lit("")) == "").alias("blank"),
    )
    is_meta = F.col("semantic").isNull() & F.col("metadata").isNotNull()
    is_channel = F.col("semantic").isNull() & F.col("metadata").isNull()
    dup = lambda c: (F.count(c) > F.count_distinct(c))
    per = named.groupBy("source").agg(
        F.sum("same_key").alias("n_columns"),
        F.bool_or("blank").alias("blank"),
        (F.max("same_key") > 1).alias("dup_header"),
        dup(F.col("semantic")).alias("dup_semantic"),
        F.array_sort(F.collect_set("semantic")).alias("roles"),
        dup(F.when(is_meta, F.col("metadata"))).alias("dup_metadata"),
        F.count_if(F.col("semantic").isNull() & F.col("channel").isNotNull()).alias("n_known"),
        dup(F.when(is_channel, F.col("channel"))).alias("dup_channel"),
        F.count_if(is_channel).alias("n_channels"),
    )
    long = F.col("roles") == F.array(F.lit("telemetry"), F.lit("time"), F.lit("value"))
    wide = F.col("roles") == F.array(F.lit("time"))
    many = F.lit(False) if max_columns is None else F.col("n_columns") > max_columns
    state = (
        F.when((F.col("n_columns") < 2) | many | F.col("blank"), "telemetry_table_columns_required")
        .when(F.col("dup_header") | F.col("dup_semantic"), "ambiguous_header")
        .when(long & (F.col("n_known") > 0), "mixed_table_layout")
        .when(F.col("dup_metadata") & (long | wide), "ambiguous_metadata_header")
        .when(long, "long")
        .when(wide & F.col("dup_channel"), "ambiguous_wide_channel")
        .when(wide & (F.col("n_channels") == 0), "wide_table_telemetry_required")
        .when(wide, "wide")
        .when((F.col("n_columns") == 3), "unknown_header")
        .otherwise("long_table_columns_required")
    )
    return per.select("source", "n_columns", state.alias("layout"))


def wide_to_long(df: DataFrame, ids: list[str], channels: list[str]) -> DataFrame:
    """One reading per channel cell; blank cells give none."""
    return df.unpivot(ids, channels, "channel", "value").where(F.col("value").isNotNull())


def long_to_steps(readings: DataFrame, required: list[str], t: str = "t") -> DataFrame:
    """One row per unit and time with a column for every required channel."""
    cells = [F.first(F.when(F.col("channel") == c, F.col("value")), ignorenulls=True).alias(c) for c in required]
    return readings.where(F.col("channel").isin(*required)).groupBy("unit_id", t).agg(*cells)


def resolve_time_unit(requested: Column, hint: Column, allowed: Column) -> Column:
    """Unit of a numeric time column, or why none can be used (``unit``, ``code``, ``basis``)."""
    valid = ["auto", "cycle", "bin", *fv.SECONDS_PER_UNIT]
    chosen = F.when(requested == "auto", hint).otherwise(requested)
    code = (
        F.when(~F.coalesce(requested.isin(*valid), F.lit(False)), "invalid_time_unit")
        .when((requested != "auto") & hint.isNotNull() & (requested != hint), "time_unit_conflict")
        .when(chosen.isNull(), "time_unit_required")
        .when(~F.array_contains(allowed, chosen), "unsupported_time_unit")
    )
    return F.struct(
        F.when(code.isNull(), chosen).alias("unit"),
        code.alias("code"),
        F.when(code.isNull(), F.when(hint.isNotNull(), "header").otherwise("user_selected")).alias("basis"),
    )


def requested_units(files: DataFrame, units: list[str], position: str = "file_index") -> DataFrame:
    """Requested unit per file; a single one applies to all files of the batch."""
    if len(units) == 1:
        return files.withColumn("requested", F.lit(units[0]))
    listed = F.array(*[F.lit(u) for u in units])
    return files.withColumn("requested", F.get(listed, F.col(position)))


def metadata_summary(rows: DataFrame, key: list[str], columns: list[str], shown: int = 8) -> DataFrame:
    """Per key and metadata column: filled cells, distinct values, the first few of them."""
    cells = rows.unpivot(key, columns, "field", "text").where(F.coalesce(F.trim("text"), F.lit("")) != "")
    values = cells.groupBy(*key, "field", F.trim("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    ranked = values.groupBy(*key, "field").agg(
        F.sum("n").alias("nonempty_count"),
        F.count(F.lit(1)).alias("n_distinct"),
    )
    return ranked.withColumn("truncated", F.col("n_distinct") > shown).withColumn("is_static", F.col("n_distinct") == 1)


def first_values(rows: DataFrame, key: list[str], column: str, shown: int = 8, order: list[str] | None = None) -> DataFrame:
    """The first distinct values per key as rows: by ``order`` of appearance, else in byte order.

    Values are reduced to their first place before the exchange, and every partition keeps ``shown``
    rows of a key, so a hot key is no burden.
    """
    filled = rows.withColumn("text", F.trim(column)).where("text <> ''")
    place = F.struct(*order) if order else F.col("text")
    values = filled.groupBy(*key, "text").agg(F.min(place).alias("__place"))
    placed = values.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("__place")))
    return placed.where(F.col("rank") <= shown).select(*key, "text", (F.col("rank") - 1).cast("long").alias("rank"))


def values_by_channel(rows: DataFrame, key: list[str], channel: str, column: str, order: list[str], shown: int = 8) -> DataFrame:
    """The first distinct values of each channel in order of appearance, and whether it has several."""
    firsts = first_values(rows, [*key, channel], column, shown, order)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return firsts.groupBy(*key, channel).agg(listed.alias("texts")).withColumn("inconsistent", F.size("texts") > 1)


def text_search(rows: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Rows whose fields hold all tokens of a query, as they stand or as search keys (compatibility
    form, lower case, without separators)."""
    found, keys = rows, []
    for i, f in enumerate(fields):
        found = with_nfkc(found, f, f"__nfkc{i}")
        keys.append(f"__nfkc{i}")
    hit = sc.contains_all_tokens([F.col(f) for f in fields], query, [F.col(k) for k in keys])
    return found.where(hit).select(*sg.columns_of(rows))
