"""Metrics, gates, summaries and public views of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifespan import fixed_values as fv
from lifespan.functions import scalar as sc
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis


def regression_metrics(rows: DataFrame, axis: Axis, pred: str = "y_pred", truth: str = "y_true") -> DataFrame:
    """RMSE, MAE, bias, mean of unit RMSEs and the share of rising neighbour pairs."""
    pairs = sg.previous_row(rows, axis, [pred], "prev_")
    error = F.col(pred) - F.col(truth)
    per_unit = pairs.groupBy(*axis.unit).agg(
        F.sum(error * error).alias("sq"),
        F.sum(F.abs(error)).alias("ab"),
        F.sum(error).alias("er"),
        F.count(F.lit(1)).alias("n"),
        F.count(f"prev_{pred}").alias("pairs"),
        F.count_if(F.col(pred) > F.col(f"prev_{pred}") + 1e-9).alias("up"),
    )
    n = F.sum("n")
    return per_unit.agg(
        F.sqrt(F.sum("sq") / n).alias("rmse"),
        (F.sum("ab") / n).alias("mae"),
        (F.sum("er") / n).alias("bias"),
        F.avg(F.sqrt(F.col("sq") / F.col("n"))).alias("unit_macro_rmse"),
        F.try_divide(F.sum("up"), F.sum("pairs")).alias("upward_fraction"),
        n.alias("n_windows"),
        F.count(F.lit(1)).alias("n_units"),
    )


def smooth_l1(pred: Column, truth: Column) -> Column:
    gap = F.abs(pred - truth)
    return F.avg(F.when(gap < 1.0, 0.5 * gap * gap).otherwise(gap - 0.5))


def seed_metric_summary(results: DataFrame, metric: str, key: str = "component") -> DataFrame:
    """Mean, min, max over seeds of an adopted validation metric in [0, 1].

    One value per seed; a seed with two different values voids the whole component.
    """
    adopted = F.lower(F.trim(F.col("adopted").cast("string"))).isin("true", "1")
    seed_text = F.trim(F.col("seed").cast("string"))
    value = F.trim(F.col(metric).cast("string")).try_cast("double")
    usable = (
        adopted
        & (F.lower(F.trim("split")) == "val")
        & seed_text.rlike(r"^\d{1,12}(\.0+)?$")
        & sc.finite(value)
        & value.between(0.0, 1.0)
    )
    per_seed = (
        results.where(usable)
        .groupBy(key, seed_text.cast("double").cast("bigint").alias("seed"))
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
    )
    summary = per_seed.groupBy(key).agg(
        F.bool_and(F.col("low") == F.col("high")).alias("consistent"),
        F.round(F.avg("low"), 12).alias("mean"),
        F.min("low").alias("minimum"),
        F.max("low").alias("maximum"),
        F.count(F.lit(1)).alias("seed_count"),
    )
    return summary.where("consistent").drop("consistent")


def metric_delta(baseline: DataFrame, adapted: DataFrame, key: str = "component", metric: str = "rmse") -> DataFrame:
    """Baseline metric minus adapted metric, in the unit of the label."""
    a = baseline.select(key, F.col(metric).alias("baseline"))
    b = adapted.select(key, F.col(metric).alias("adapted"))
    return a.join(b, key).withColumn("change", F.col("baseline") - F.col("adapted"))


def release_gate(metrics: DataFrame, limits: DataFrame, key: str = "component") -> DataFrame:
    """Per component whether rmse and mae are within their limits."""
    joined = metrics.join(limits, key)
    return joined.withColumn(
        "passed",
        F.coalesce((F.col("rmse") <= F.col("max_rmse")) & (F.col("mae") <= F.col("max_mae")), F.lit(False)),
    )


def select_best(candidates: DataFrame, key: str = "component", score: str = "rmse", name: str = "model") -> DataFrame:
    """Lowest score per component, ties by name; partial aggregation, no window."""
    best = candidates.where(sc.finite(F.col(score))).groupBy(key).agg(
        F.min(F.struct(F.col(score), F.col(name))).alias("b")
    )
    return best.select(key, f"b.{name}", f"b.{score}")


def state_counts(rows: DataFrame, state: str = "state") -> DataFrame:
    return rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"))


def state_members(rows: DataFrame, states: list[str], key: str, state: str = "state") -> DataFrame:
    """Ids per reported state as rows: a state may hold any number of them."""
    return rows.where(F.col(state).isin(*states)).select(state, key)


def bundle_by_unit(rows: DataFrame, axis: Axis, fields: list[str], part_rows: int = 10_000) -> DataFrame:
    """Time-sorted arrays of row structs per unit, in numbered parts of bounded size."""
    numbered = sg.row_numbers(rows, axis, "__p", "unit_rows")
    return numbered.groupBy(*axis.unit, F.floor(F.col("__p") / part_rows).alias("part")).agg(
        F.max("unit_rows").alias("unit_rows"),
        F.sort_array(F.collect_list(F.struct("__p", *fields))).alias("rows"),
    )


def batch_status(files: DataFrame, batch: str = "batch") -> DataFrame:
    """complete, partial or rejected, from one flag per submitted file."""
    return (
        files.groupBy(batch)
        .agg(
            F.count(F.lit(1)).alias("submitted"),
            F.count_if("predicted").alias("predicted"),
            F.count_if(~F.col("predicted")).alias("rejected"),
        )
        .withColumn(
            "status",
            F.when(F.col("rejected") == 0, "complete").when(F.col("predicted") > 0, "partial").otherwise("rejected"),
        )
    )


def age_scale(train: DataFrame, t: str = "t_end") -> DataFrame:
    return train.agg(F.max(t).alias("age_scale"))


def epoch_median(members: DataFrame, key: str = "component", epochs: str = "epochs") -> DataFrame:
    """Whole-number median of the epochs chosen by the members of a component."""
    return members.groupBy(key).agg(F.median(epochs).cast("int").alias("epochs"))


def interval_coverage(rows: DataFrame, key: list[str]) -> DataFrame:
    inside = F.col("y_true").between(F.col("p10"), F.col("p90")).cast("double")
    return rows.groupBy(*key).agg(
        F.avg(inside).alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("mean_width")
    )


def alpha_lambda(rows: DataFrame, alpha: float = 0.2, axis: Axis | None = None) -> DataFrame:
    """Share of windows within ±alpha of the truth and the earliest lasting relative life.

    ``horizon`` is one minus the relative age after which no window leaves the band
    (null when the last window is outside).  Windows meet once per unit and end; the end behind the
    last one outside comes from its neighbour, so nothing is joined.
    """
    inside = F.abs(F.col("y_pred") - F.col("y_true")) <= alpha * F.col("y_true")
    ends = rows.groupBy("unit_id", "t_end").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"))
    placed = sg.next_row(ends, axis or Axis.fit(ends, ("unit_id",), ("t_end",)), ["t_end"])
    outside = F.when(F.col("n_inside") < F.col("n"), F.col("t_end"))
    per_unit = placed.groupBy("unit_id").agg(
        (F.sum("n_inside") / F.sum("n")).alias("accuracy"),
        F.max("t_end").alias("life"),
        F.min("t_end").alias("first"),
        F.max(outside).alias("last_out"),
        F.max_by("next_t_end", outside).alias("after"),
    )
    start = F.when(F.col("last_out").isNull(), F.col("first")).otherwise(F.col("after"))
    return per_unit.select("unit_id", "accuracy", (1.0 - start / F.col("life")).alias("horizon"))


def metrics_by_split(ledger: DataFrame) -> DataFrame:
    """Validation and hold-out metrics side by side where both runs passed."""
    cell = lambda split, m: F.max(F.when(F.col("split") == split, F.col(m))).alias(f"{split}_{m}")
    return (
        ledger.where(F.col("split").isin("validation", "holdout"))
        .groupBy("component")
        .agg(
            *[cell(s, m) for s in ("validation", "holdout") for m in ("rmse", "mae", "n_windows", "n_units")],
            (F.bool_and(F.col("status") == "pass") & (F.count_distinct("split") == 2)).alias("available"),
        )
    )


def dataset_tiers(manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """File count and bytes per tier against the declared ones."""
    found = manifest.groupBy("tier").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"))
    joined = declared.join(found, "tier", "left")
    same = F.col("file_count").eqNullSafe(F.col("declared_files")) & F.col("total_bytes").eqNullSafe(
        F.col("declared_bytes")
    )
    return joined.withColumn("matches", same)


#: Fixed order of the fields that say what a dataset is.
DATASET_FIELDS = (
    "schema_version", "dataset_id", "display_name", "domain", "role", "product_line", "profile", "t_unit", "license_cite", "source_url",
    "parser", "created_utc", "native_checksums_ref", "notes",
)


def channel_list(t_unit: Column, names: list[str], described: dict[str, str] = {}) -> Column:
    """Name, unit, visibility, type and description of channels; the unit of time is the dataset's."""
    unit = lambda n: t_unit if fv.CHANNEL_DICTIONARY[n][0] == "t_unit" else F.lit(fv.CHANNEL_DICTIONARY[n][0])
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), unit(n).alias("unit"), F.lit(fv.CHANNEL_DICTIONARY[n][1]).alias("visibility"),
                F.lit(fv.CHANNEL_DICTIONARY[n][2]).alias("dtype"), F.lit(described.get(n, "")).alias("desc"),
            )
            for n in names
        ]
    )


def dataset_documents(datasets: DataFrame, names: list[str], described: dict[str, str] = {}) -> DataFrame:
    """``dataset_id, document``: the document of each dataset without its units, as JSON.

    ``datasets`` has a row per dataset with the columns of ``DATASET_FIELDS`` it knows; the others
    are empty texts, as is a null.
    """
    known = {f.name: f.dataType for f in datasets.schema.fields}
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if isinstance(known[c], T.StringType) else F.col(c)
    fields = [(blank(c) if c in known else F.lit("")).alias(c) for c in DATASET_FIELDS]
    channels = channel_list(F.col("t_unit"), names, described).alias("channels")
    return datasets.select("dataset_id", F.to_json(F.struct(*fields, channels)).alias("document"))


def unit_documents(registry: DataFrame, keys: tuple[str, ...] = (), part_units: int = 1000) -> DataFrame:
    """Units of each dataset as JSON maps sorted by id, in hashed parts of bounded size.

    A part has about ``part_units`` units: the number of parts follows that of the units.
    """
    total = registry.agg(F.count(F.lit(1))).scalar()
    parts = F.greatest(F.lit(1), F.ceil(total / F.lit(part_units)))
    entry = F.struct(*[c for c in registry.columns if c not in ("unit_id", *keys)])
    part = F.pmod(F.xxhash64(F.col("unit_id").cast("string")), parts).alias("part")
    pairs = F.sort_array(F.collect_list(F.struct(F.col("unit_id").cast("string").alias("key"), entry.alias("value"))))
    grouped = registry.groupBy(*keys, part).agg(F.map_from_entries(pairs).alias("units"))
    return grouped.select(*keys, "part", F.size("units").alias("n_units"), F.to_json("units").alias("document"))


# -- public view -------------------------------------------------------------
def public_projection(
    rows: DataFrame, key: str, texts: dict[str, int], numbers: list[str], ratios: list[str], counts: list[str],
    deny: str, order: str,
) -> DataFrame:
    """Allow-listed columns only; unsafe or malformed cells become null.

    The first row of an id in ``order`` wins.
    """
    def text(c, limit):
        t = F.trim(c)
        return F.when((t != "") & (F.char_length(t) <= limit) & ~t.rlike(deny), t)

    picked = [
        F.col(key),
        F.col(order),
        *[text(c, n).alias(c) for c, n in texts.items()],
        *[sc.finite_or_null(F.col(c).cast("double")).alias(c) for c in numbers],
        *[F.when(sc.finite(F.col(c)) & F.col(c).between(0.0, 1.0), F.col(c)).alias(c) for c in ratios],
        *[F.when(sc.finite(F.col(c)) & (F.col(c) >= 0) & (F.col(c) == F.floor(c)), F.col(c).cast("bigint")).alias(c) for c in counts],
    ]
    view = rows.where(F.col(key).cast("string").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$")).select(*picked)
    rest = [c for c in view.columns if c != key]
    firsts = view.groupBy(key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("__r"))
    return firsts.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def rename_public(df: DataFrame, names: dict[str, str], words: dict[str, str], counted: tuple[str, ...] = ()) -> DataFrame:
    """Public names of columns and of fields at any depth, private words replaced in all texts.

    A field in ``counted`` is shown as the length of its list (null if it is none).  Two fields that
    would get one name are an error.  Keys of maps are renamed as names are.
    """

    def public(key: str) -> str:
        return names.get(key, key)

    def cell(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            for old, new in words.items():
                value = F.replace(value, F.lit(old), F.lit(new))
            return value
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: cell(x, kind.elementType))
        if isinstance(kind, T.MapType):
            renamed = F.transform_values(value, lambda k, v: cell(v, kind.valueType))
            if not isinstance(kind.keyType, T.StringType):
                return renamed
            listed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map()
            return F.transform_keys(renamed, lambda k, v: F.coalesce(F.try_element_at(listed, k), k))
        if isinstance(kind, T.StructType):
            fields = [member(value[f.name], f) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return value

    def member(value: Column, field: T.StructField) -> Column:
        if field.name in counted:
            is_list = isinstance(field.dataType, T.ArrayType)
            value = F.when(value.isNotNull(), F.size(value)) if is_list else F.lit(None).cast("int")
            return value.alias(public(field.name))
        return cell(value, field.dataType).alias(public(field.name))

    shown = [public(f.name) for f in df.schema.fields]
    if len(set(shown)) < len(shown):
        raise ValueError(f"two columns would be named {sorted(n for n in shown if shown.count(n) > 1)[0]}")
    return df.select(*[member(F.col(f"`{f.name}`"), f) for f in df.schema.fields])
