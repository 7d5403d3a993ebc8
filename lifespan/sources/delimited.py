"""Delimited text: telemetry tables, prediction files, commented summaries."""

from __future__ import annotations

import codecs
import csv
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifespan.config import BROADCAST_ROWS
from lifespan.functions.scalar import finite, mask_ids, round_half_even
from lifespan.sources.storage import cut_lineage, listed, opened

SEPARATORS = (",", "\t", ";")
PREDICTION_COLUMNS = ("window_id", "unit_id", "t_end", "route_id", "prediction", "rul_unit", "truth")


# -- dialects --------------------------------------------------------------
DIALECTS = "source string, read_from string, charset string, separator string, header array<string>, code string"
HEAD_BYTES = 1 << 16


def _dialect(name: str, head: bytes, whole: bool) -> tuple:
    """Charset, separator and header of a file by its first block; a code if it has none."""
    if not head.strip():
        return None, None, None, "empty_file"
    charset = None
    for tried in ("utf-8-sig", "gb18030"):
        try:
            # the block may end within a character
            text = codecs.getincrementaldecoder(tried)().decode(head, final=whole)
            charset = tried
            break
        except UnicodeDecodeError:
            continue
    if charset is None:
        return None, None, None, "unsupported_encoding"
    lines = [x for x in text.splitlines() if x.strip()]
    tab = name.lower().removesuffix(".gz").endswith((".tsv", ".tab"))
    separator = "\t" if tab else max(SEPARATORS, key=lines[0].count)
    if separator not in lines[0]:
        return charset, None, None, "delimiter_unknown"
    header = [h.strip() for h in next(csv.reader([lines[0]], delimiter=separator))]
    return charset, separator, header, "ambiguous_header" if len(set(header)) < len(header) or "" in header else None


def dialects(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Per file ``source, read_from, charset, separator, header, code``, by one block of each.

    ``path`` is a folder, a file or a pattern of file names.  Spark reads text as UTF-8, so files in
    GB18030 are written again as UTF-8 below ``folder``, a chunk at a time, and read from there.  A
    file whose first block is ASCII counts as UTF-8, and one that ends in ``.gz`` is read unpacked; lines that are not give a code when it is read.
    """
    store, names = listed(path)
    files = spark.createDataFrame([(n,) for n in names], "source string").repartition(max(1, min(len(names), 200)), "source")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(path)
        for batch in batches:
            rows = []
            for name in batch.column("source").to_pylist():
                try:
                    with store.open_input_stream(name) as f:  # unpacked by suffix, as Spark does
                        head = f.read(HEAD_BYTES)
                except OSError:
                    rows.append((name, name, None, None, None, "invalid_file"))
                    continue
                charset, separator, header, code = _dialect(name, head, len(head) < HEAD_BYTES)
                read_from = name
                if charset == "gb18030" and code is None:
                    read_from = f"{opened(folder)[1]}/{uuid.uuid4().hex}.csv"
                    code = _as_utf8(store, name, read_from)
                rows.append((name, read_from, charset, separator, header, code))
            columns = zip(*rows) if rows else [()] * 6
            kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in DIALECTS.split(", ")])

    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    return cut_lineage(files.mapInArrow(look, DIALECTS))


def _as_utf8(store, name: str, target: str) -> str | None:
    decoder = codecs.getincrementaldecoder("gb18030")()
    try:
        with store.open_input_stream(name) as f, store.open_output_stream(target, compression=None) as out:
            while data := f.read(1 << 20):
                out.write(decoder.decode(data).encode())
            out.write(decoder.decode(b"", final=True).encode())
    except UnicodeDecodeError:
        return "unsupported_encoding"
    except OSError:
        return "invalid_file"
    return None


def read_delimited_files(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(source, record_id, column, text)`` cells of all files, and ``(source, line, code)`` issues.

    Files of one separator and width are read together, by Spark's own splittable reader.  A line of
    another width, or one that is not text, is an issue and gives no cells; a file that has no
    dialect is an issue without a line.  The other lines and files are read.
    """
    found = dialects(spark, path, folder)
    issues = found.where(F.col("code").isNotNull()).select("source", F.lit(None).cast("string").alias("line"), "code")
    sound = found.where(F.col("code").isNull()).withColumn("width", F.size("header"))
    # a row per file, as in any listing of files that is planned
    groups: dict[tuple[str, int], list[str]] = {}
    for r in sound.select("read_from", "separator", "width").collect():
        groups.setdefault((r["separator"], r["width"]), []).append(r["read_from"])
    heads = sound.select(F.col("read_from").alias("__from"), "source", "header")
    side = F.broadcast(heads) if sum(map(len, groups.values())) <= BROADCAST_ROWS else heads
    parts = []
    for (separator, width), names in sorted(groups.items()):
        fields = [f"c{i}" for i in range(width)]
        schema = ", ".join(f"{c} string" for c in [*fields, "__bad"])
        prefix = scheme(path)
        raw = (
            spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "__bad").option("escape", '"').csv([prefix + n for n in names])
        )
        parts.append(raw.select(F.array(*fields).alias("values"), "__bad", F.col("_metadata.file_path").alias("__path")))
    if not parts:
        return spark.createDataFrame([], "source string, record_id long, column string, text string"), issues
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    plain = F.regexp_replace(F.url_decode(F.replace("__path", F.lit("+"), F.lit("%2B"))), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/{0,2}(?=/)", "")
    named = rows.withColumn("__from", plain).join(side, "__from").withColumn("record_id", F.monotonically_increasing_id())
    broken = F.exists("values", lambda v: v.contains("\ufffd"))
    code = F.when(F.col("__bad").isNotNull(), "row_column_count").when(broken, "unsupported_encoding")
    marked = named.withColumn("code", code)
    bad = marked.where(F.col("code").isNotNull())
    line = F.coalesce("__bad", F.array_join("values", ","))
    pairs = F.explode(F.arrays_zip(F.col("header").alias("column"), F.transform("values", lambda v: F.coalesce(v, F.lit(""))).alias("text"))).alias("cell")
    cells = marked.where(F.col("code").isNull()).select("source", "record_id", pairs)
    return cells.select("source", "record_id", "cell.column", "cell.text"), issues.unionByName(bad.select("source", line.alias("line"), "code"))


def scheme(path: str) -> str:
    """What stands before the path of a file in its address."""
    return path[: path.index("://") + 3] if "://" in path else "file:" if path.startswith("file:") else ""


def read_commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose lines starting with ``#`` are skipped."""
    return spark.read.option("header", True).option("comment", "#").csv(path)


def read_prediction_csv(spark: SparkSession, path: str | list[str], route: str) -> DataFrame:
    """Columns are found by their header, in any order; one that is missing is null."""
    found = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    raw = found.select(*(F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string").alias(c) for c in PREDICTION_COLUMNS))
    return classify_predictions(raw, route)


def classify_predictions(raw: DataFrame, route: str) -> DataFrame:
    """Typed prediction rows; ``valid`` is false for a missing key, another route or a bad number."""
    number = lambda c: round_half_even(F.trim(F.col(c)).try_cast("double"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    t, p, y = number("t_end"), number("prediction"), number("truth")
    valid = (
        (text("unit_id") != "")
        & (text("window_id") != "")
        & (text("route_id") == route)
        & finite(t) & finite(p) & finite(y)
    )
    return raw.select(
        mask_ids(text("window_id")).alias("window_id"),
        mask_ids(text("unit_id")).alias("unit_id"),
        t.alias("t"), y.alias("y_true"), p.alias("p50"),
        valid.alias("valid"),
    )


def prediction_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count_if("valid").alias("n_windows"),
        F.count_if(~F.col("valid")).alias("invalid_rows"),
        F.count_distinct(F.when(F.col("valid"), F.col("unit_id"))).alias("n_units"),
    )

