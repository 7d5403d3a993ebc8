"""Integrity of stored data: manifests, fingerprints, record agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8


def row_digest(columns: list[Column]) -> Column:
    """Digest of a row; null and the empty text stay different."""
    cells = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *cells), 256)


def fingerprint(df: DataFrame, columns: list[Column], keys: list[str] = ()) -> DataFrame:
    """Content fingerprint of a table, or one per key.

    Row digests are added up lane by lane, so the result does not depend on row order
    and a hash aggregation with partials computes it: nothing is sorted or collected.
    """
    digests = df.select(*keys, row_digest(columns).alias("d"))
    lanes = [
        F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("bigint")).alias(f"s{i}") for i in range(LANES)
    ]
    summed = digests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *lanes)
    joined = F.concat_ws("-", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(LANES)])
    return summed.select(*keys, "n_rows", F.sha2(joined, 256).alias("fingerprint"))


def unchanged(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose fingerprint is new, gone or different; empty when nothing moved."""
    a = before.select(*keys, F.col("fingerprint").alias("before"))
    b = after.select(*keys, F.col("fingerprint").alias("after"))
    return a.join(b, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def manifest_audit(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """ok, missing, changed or extra per path.

    ``found`` is ``(path, bytes, sha256)``, ``manifest`` ``(path, expected_bytes, expected_sha256)``.
    """
    joined = found.join(manifest, "path", "full")
    return joined.select(
        "path",
        F.when(F.col("expected_sha256").isNull(), "extra")
        .when(F.col("sha256").isNull(), "missing")
        .when((F.col("bytes") != F.col("expected_bytes")) | (F.col("sha256") != F.col("expected_sha256")), "changed")
        .otherwise("ok")
        .alias("state"),
    )


def inside_root(path: Column, aliases: dict[str, str] = {}) -> tuple[Column, Column]:
    """Path relative to its root after alias prefixes, and whether it stays inside."""
    relative = path
    for prefix, target in aliases.items():
        relative = F.when(
            path.startswith(prefix), F.concat(F.lit(target), path.substr(F.lit(len(prefix) + 1), F.length(path)))
        ).otherwise(relative)
    escapes = (
        relative.startswith("/")
        | relative.contains("\\")
        | relative.rlike(r"^[A-Za-z]:")
        | relative.rlike(r"(^|/)\.\.(/|$)")
        | (F.coalesce(relative, F.lit("")) == "")
    )
    return relative, ~escapes


def record_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields in which two ledger records of the same key disagree."""
    a, b = left.alias("a"), right.alias("b")
    diff = F.filter(
        F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]),
        lambda f: f.isNotNull(),
    )
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        F.array_join(diff, ",").alias("differing"),
        (F.size(diff) == 0).alias("reusable"),
    )


def stored_differences(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows on one side only; NaN equals NaN and the column order must be the same."""
    if stored.columns != computed.columns:
        raise ValueError(f"columns differ: {stored.columns} and {computed.columns}")
    return (
        stored.exceptAll(computed).withColumn("only_in", F.lit("stored"))
        .unionByName(computed.exceptAll(stored).withColumn("only_in", F.lit("computed")))
    )
