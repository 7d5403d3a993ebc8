"""Queries for windows, features, statistics, bins and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifespan.fixed_values import STATISTICS
from lifespan.functions import scalar as sc
from lifespan.operators import binning, features, split, stats, windows
from lifespan.operators import segments as sg
from lifespan.plans.registry import (
    EMBEDDING_CELLS, READINGS, STEPS, SUPPLIER_DAYS, WINDOW_CELLS, query, stats_sql,
)
from lifespan.sources import tables as tb

CH = list(tb.EVENT_CHANNELS)
LENGTH, STRIDE = 16, 4
EDGE = 3


def rounded(df, columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def training(df):
    """Rows of training units: those with a digest in the lower 13/16 of the range."""
    return df.where(split.digest(0) < "d")


def step_windows(spark, base):
    axis = tb.event_axis(spark, base)
    steps = tb.event_steps(spark, base, axis)
    w = windows.sliding_windows(
        steps, list(tb.STEP_CHANNELS), LENGTH, STRIDE, carry=["t", "n_steps"], axis=axis
    )
    return w.withColumnRenamed("t", "t_end")


# -- binning ---------------------------------------------------------------
_BIN_COLS = [f"{c}_{s}" for c in CH for s in ("mean", "std", "min", "max", "n")]


@query(
    "a01_bin_aggregate",
    "WITH" + READINGS + """
SELECT unit_id, CAST(floor(t / 86400.0) AS BIGINT) AS bin, max(t) AS t_end, """
    + ", ".join(
        f"round(avg(value) FILTER (channel = '{c}'), 6) AS {c}_mean, "
        f"round(stddev_samp(value) FILTER (channel = '{c}'), 6) AS {c}_std, "
        f"min(value) FILTER (channel = '{c}') AS {c}_min, max(value) FILTER (channel = '{c}') AS {c}_max, "
        f"count(*) FILTER (channel = '{c}') AS {c}_n"
        for c in CH
    )
    + " FROM ev GROUP BY 1, 2",
)
def bin_aggregate(spark, base):
    out = binning.bin_aggregate(tb.event_readings(spark, base), CH, tb.DAY_S)
    out = out.toDF("unit_id", "bin", "t_end", *_BIN_COLS)
    return rounded(out, [c for c in _BIN_COLS if c.endswith(("_mean", "_std"))])


_BINS_SQL = "WITH" + READINGS + """,
b AS (SELECT unit_id, CAST(floor(t / 86400.0) AS BIGINT) AS bin, avg(value) FILTER (channel = 'purchase') AS cur,
             avg(value) FILTER (channel = 'click') AS temp FROM ev WHERE channel IN ('purchase', 'click') GROUP BY 1, 2)"""


def _pair_bins(spark, base):
    out = binning.bin_aggregate(tb.event_readings(spark, base), ["purchase", "click"], tb.DAY_S)
    return out.select(
        "unit_id", "bin", F.col("`purchase.mean`").alias("cur"), F.col("`click.mean`").alias("temp")
    )


@query(
    "a02_fit_baseline",
    _BINS_SQL + """
SELECT round(regr_intercept(cur, temp), 6) AS intercept, round(regr_slope(cur, temp), 9) AS slope,
       count(*) FILTER (cur IS NOT NULL AND temp IS NOT NULL) AS n, coalesce(var_pop(temp) <= 1e-12, true) AS degenerate
FROM b WHERE sha256('0:' || unit_id) < 'd'""",
)
def fit_baseline(spark, base):
    train = training(_pair_bins(spark, base))
    fit = stats.fit_baseline(train, "cur", "temp")
    return fit.select(
        F.round("intercept", 6).alias("intercept"), F.round("slope", 9).alias("slope"), "n", "degenerate"
    )


@query(
    "p16_friction_feature",
    _BINS_SQL + "SELECT unit_id, bin, round(cur - (40.0 + 0.25 * temp), 6) AS friction FROM b",
)
def friction(spark, base):
    f = sc.friction_feature(F.col("cur"), F.col("temp"), F.lit(40.0), F.lit(0.25))
    return _pair_bins(spark, base).select("unit_id", "bin", F.round(f, 6).alias("friction"))


# The battery stand-in: one cycle is a day, current = value - 40, soh falls with time.
_CYCLE_SQL = "WITH" + STEPS + """,
smp AS (SELECT unit_id, t, value - 40.0 AS current, hour AS temp, 1.0 - step / n_steps * 0.4 AS soh FROM st),
par AS (SELECT unit_id, CAST(floor(t / 86400.0 + 1e-9) AS BIGINT) AS cycle, count(*) AS n_samples, avg(temp) AS temp_mean,
               count(*) FILTER (current < 0) * 10e0 AS charge_time, avg(abs(current)) / 2.0 AS c_rate_mean,
               arg_min(soh, t) AS first_soh FROM smp GROUP BY 1, 2),
cyc AS (SELECT p.unit_id, p.cycle, p.n_samples, p.temp_mean, p.charge_time, p.c_rate_mean, n.first_soh AS soh, 2.0 * n.first_soh AS capacity
        FROM par p JOIN par n ON n.unit_id = p.unit_id AND n.cycle = p.cycle + 1)"""


def _cycles(spark, base):
    st = tb.event_steps(spark, base)
    soh = F.lit(1.0) - F.col("step") / F.col("n_steps") * 0.4
    samples = st.select(
        "unit_id", "t", (F.col("value") - 40.0).alias("current"), F.col("hour").alias("temp"),
        soh.alias("soh"), sc.battery_health(soh).alias("hi"),
    )
    return binning.reconstruct_cycles(samples, tb.DAY_S, 10.0, 2.0, per_cycle=None)


@query(
    "a03_cycle_reconstruct",
    _CYCLE_SQL + """ SELECT unit_id, cycle, n_samples, round(temp_mean, 6) AS temp_mean, charge_time,
    round(c_rate_mean, 6) AS c_rate_mean, round(soh, 9) AS soh, round(capacity, 9) AS capacity FROM cyc""",
)
def cycle_reconstruct(spark, base):
    return _cycles(spark, base).select(
        "unit_id", "cycle", "n_samples", F.round("temp_mean", 6).alias("temp_mean"), "charge_time",
        F.round("c_rate_mean", 6).alias("c_rate_mean"), F.round("soh", 9).alias("soh"),
        F.round("capacity", 9).alias("capacity"),
    )


@query(
    "a04_failure_cycle",
    _CYCLE_SQL + """, f AS (SELECT unit_id, min(cycle) FILTER (capacity <= 1.6 + 1e-9) AS failure_cycle FROM cyc GROUP BY 1)
SELECT c.unit_id, c.cycle, failure_cycle, failure_cycle IS NULL AS censored, failure_cycle - c.cycle AS rul,
       CAST(coalesce(c.cycle >= failure_cycle, false) AS INTEGER) AS fail FROM cyc c JOIN f USING (unit_id)""",
)
def failure_cycle(spark, base):
    return binning.failure_cycle(_cycles(spark, base)).select(
        "unit_id", "cycle", "failure_cycle", "censored", "rul", "fail"
    )


@query(
    "a04_failure_cross_check",
    _CYCLE_SQL + """, f AS (SELECT unit_id, min(cycle) FILTER (capacity <= 1.6 + 1e-9) AS failure_cycle FROM cyc GROUP BY 1)
SELECT unit_id, failure_cycle FROM f WHERE failure_cycle IS NOT NULL AND unit_id % 4 >= 2""",
)
def failure_cross_check(spark, base):
    labelled = binning.failure_cycle(_cycles(spark, base)).select(
        "unit_id", "failure_cycle", (F.col("failure_cycle") + F.col("unit_id") % 4 + 0.5).alias("failure_days")
    )
    return binning.failure_cross_check(labelled, "failure_days", tb.DAY_S).select("unit_id", "failure_cycle").distinct()


@query(
    "j09_settlement_join",
    "WITH" + SUPPLIER_DAYS + """,
m AS (SELECT unit_id, CAST(floor(t / 28) AS BIGINT) AS cycle, arg_min(price, t) AS first_price, sum(n_lines)::BIGINT AS n_lines FROM sd GROUP BY 1, 2)
SELECT a.unit_id, a.cycle, a.n_lines, b.first_price AS settled FROM m a JOIN m b ON b.unit_id = a.unit_id AND b.cycle = a.cycle + 1""",
)
def settlement_join(spark, base):
    d = tb.supplier_days(spark, base).withColumn("cycle", F.floor(F.col("t") / 28))
    m = d.groupBy("unit_id", "cycle").agg(
        F.min_by("price", "t").alias("first_price"), F.sum("n_lines").alias("n_lines")
    )
    nxt = m.select("unit_id", (F.col("cycle") - 1).alias("cycle"), F.col("first_price").alias("settled"))
    return m.drop("first_price").join(nxt, ["unit_id", "cycle"])


@query(
    "a05_first_crossing",
    "WITH" + STEPS + """,
pr AS (SELECT unit_id, t, value, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM st WINDOW w AS (PARTITION BY unit_id ORDER BY t, row_number))
SELECT unit_id, round(min(CASE WHEN pv IS NULL THEN t ELSE pt + (100.0 - pv) / (value - pv) * (t - pt) END), 4) AS crossing_time
FROM pr WHERE value >= 100 AND (pv IS NULL OR pv < 100) GROUP BY 1""",
)
def first_crossing(spark, base):
    axis = tb.event_axis(spark, base)
    out = binning.first_crossing(tb.event_steps(spark, base, axis), axis, "value", 100.0)
    return rounded(out, ["crossing_time"], 4)


@query(
    "a06_sustained_exceedance",
    "WITH" + STEPS + """,
o AS (SELECT unit_id, t, row_number, CAST(value > 30 AS INTEGER) AS over FROM st),
g AS (SELECT *, sum(CASE WHEN over = 1 AND coalesce(po, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY t, row_number) AS run
      FROM (SELECT *, lag(over) OVER (PARTITION BY unit_id ORDER BY t, row_number) AS po FROM o)),
r AS (SELECT unit_id, run, min(t) AS s, max(t) AS e FROM g WHERE over = 1 GROUP BY 1, 2)
SELECT unit_id, min(s) AS first_time FROM r WHERE e - s >= 86400 GROUP BY 1""",
)
def sustained(spark, base):
    axis = tb.event_axis(spark, base)
    return binning.sustained_exceedance(
        tb.event_steps(spark, base, axis), axis, "value", 30.0, 86400.0
    )


@query(
    "a10_unit_registry",
    "WITH" + STEPS + """,
f AS (SELECT unit_id, CASE WHEN max(value) >= 150 THEN max(t) FILTER (value >= 150) END AS ft, CAST(max(k) AS BIGINT) % 3 AS code FROM st GROUP BY 1)
SELECT st.unit_id, count(*) AS n_rows, min(t) AS t_start, max(t) AS t_end, max(ft) AS failure_time, max(ft) IS NULL AS censored,
       CASE WHEN max(ft) IS NULL OR max(code) = 0 THEN 'none' WHEN max(code) = 1 THEN 'rw_wear_over_threshold' ELSE 'rw_speed_tracking_fail' END AS failure_mode,
       'unit_' || st.unit_id || '.parquet' AS file
FROM st JOIN f USING (unit_id) GROUP BY st.unit_id""",
)
def unit_registry(spark, base):
    st = tb.event_steps(spark, base)
    failed = F.max(F.when(F.col("value") >= 150, F.col("t")))
    return binning.unit_registry(st, failure_time=failed, failure_code=(F.max("k").cast("bigint") % 3).cast("int")).drop("failure_code")


# -- normalisation -----------------------------------------------------------
@query(
    "a07_fit_norm_stats",
    "WITH" + READINGS + """
SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n, false AS absent, false AS absent_has_values
FROM ev WHERE sha256('0:' || unit_id) < 'd' GROUP BY 1""",
)
def fit_norm_stats(spark, base):
    train = training(tb.event_readings(spark, base))
    return rounded(stats.fit_norm_stats(train, CH), ["mean", "std"])


@query(
    "a07_absent_channel",
    "WITH" + READINGS + """
SELECT channel, CASE WHEN channel = 'signup' THEN 0.0 ELSE round(avg(value), 6) END AS mean,
       CASE WHEN channel = 'signup' THEN 1.0 ELSE round(stddev_samp(value), 6) END AS std,
       count(*) AS n, channel = 'signup' AS absent, channel = 'signup' AS absent_has_values
FROM ev GROUP BY 1""",
)
def absent_channel(spark, base):
    out = stats.fit_norm_stats(
        tb.event_readings(spark, base), [c for c in CH if c != "signup"], ["signup"], sample=True
    )
    return rounded(out, ["mean", "std"])


@query(
    "a09_apply_norm",
    "WITH" + READINGS + """,
n AS (SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM ev WHERE sha256('0:' || unit_id) < 'd' GROUP BY 1)
SELECT unit_id, row_number, channel, round((value - mean) / std, 6) AS norm, false AS imputed FROM ev JOIN n USING (channel)""",
)
def apply_norm(spark, base):
    ev = tb.event_readings(spark, base)
    fitted = stats.fit_norm_stats(training(ev), CH)
    out = stats.apply_norm(ev, fitted, CH)
    return out.select("unit_id", "row_number", "channel", F.round("norm", 6).alias("norm"), "imputed")


# -- windows and features ------------------------------------------------------
@query(
    "e01_sliding_windows",
    "WITH" + WINDOW_CELLS + """
SELECT unit_id, window_index, max(t_end) AS t_end, max(end_step) AS end_step, count(*) AS n_cells,
       round(sum(v * (i * 3 + c + 1)), 4) AS weighted
FROM cells GROUP BY 1, 2""",
)
def sliding(spark, base):
    w = step_windows(spark, base)
    flat = features.flat_window()
    weighted = F.aggregate(
        F.transform(flat, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return w.select(
        "unit_id", "window_index", "t_end", "end_step", F.size(flat).cast("bigint").alias("n_cells"),
        F.round(weighted, 4).alias("weighted"),
    )


@query(
    "e01_window_counts",
    "WITH" + STEPS + """
SELECT unit_id, count(*) AS n, CAST(CASE WHEN count(*) >= 60 THEN (count(*) - 60) // 5 + 1 ELSE 0 END AS BIGINT) AS n_windows
FROM st GROUP BY 1""",
)
def window_counts(spark, base):
    n = tb.event_readings(spark, base).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("n_windows", windows.window_count(F.col("n"), 60, 5).cast("bigint"))


def _stat_rows(df, keys):
    return df.select(*keys, F.posexplode("stats").alias("c", "s")).select(
        *keys, "c", *[F.round(F.col(f"s.{n}"), 6).alias(n) for n in STATISTICS]
    )


_STAT_ROUND = ", ".join(f'round("{n}", 6) AS "{n}"' for n in STATISTICS)


@query(
    "e02_channel_statistics",
    "WITH" + WINDOW_CELLS + "," + stats_sql("unit_id, window_index", EDGE)
    + f" SELECT unit_id, window_index, c, {_STAT_ROUND} FROM stats",
)
def channel_statistics(spark, base):
    w = features.with_statistics(step_windows(spark, base), LENGTH, 3)
    return _stat_rows(w, ["unit_id", "window_index"])


@query(
    "e02_embedding_statistics",
    "WITH" + EMBEDDING_CELLS + "," + stats_sql("unit_id", 5)
    + f" SELECT unit_id, CAST(c AS INTEGER) AS c, {_STAT_ROUND} FROM stats",
)
def embedding_statistics(spark, base):
    w = features.with_statistics(tb.embedding_windows(spark, base), 16, 4, edge=5)
    return _stat_rows(w, ["unit_id"])


@query(
    "e03_flatten_features",
    "WITH" + EMBEDDING_CELLS + """
SELECT unit_id, CAST(i * 4 + c AS INTEGER) AS position, v AS value FROM cells""",
)
def flatten_features(spark, base):
    w = tb.embedding_windows(spark, base)
    return w.select("unit_id", F.posexplode(features.flat_window()).alias("position", "value"))


_UNPIVOT = " UNION ALL ".join(
    f"""SELECT unit_id, CAST({p} * 4 + c AS INTEGER) AS position, 'ch' || c || ':{n}' AS feature, round("{n}", 6) AS value FROM stats"""
    for p, n in enumerate(STATISTICS)
)
_AGE = """ UNION ALL SELECT vec_id, {0}, 'age_ratio', round(vec_id / 100.0, 6) FROM embeddings
 UNION ALL SELECT vec_id, {1}, 'age_ratio_squared', round(vec_id / 100.0 * (vec_id / 100.0), 6) FROM embeddings
 UNION ALL SELECT vec_id, {2}, 'age_ratio_sqrt', round(sqrt(vec_id / 100.0), 6) FROM embeddings"""


@query(
    "e04_direct_features_long",
    "WITH" + EMBEDDING_CELLS + "," + stats_sql("unit_id", 3) + _UNPIVOT + _AGE.format(52, 53, 54),
)
def direct_long(spark, base):
    w = features.with_statistics(tb.embedding_windows(spark, base), 16, 4)
    v = w.withColumn("direct", features.direct_features("t_end", 100.0))
    names = features.feature_names([f"ch{i}" for i in range(4)])
    out = features.explode_features(v, "direct", names, ["unit_id"])
    return rounded(out, ["value"])


_INV = " UNION ALL ".join(
    f"""SELECT unit_id, {r * 13 + p} AS position, '{name}:{n}' AS feature, round({fn}("{n}"), 6) AS value FROM stats GROUP BY 1"""
    for r, (name, fn) in enumerate(
        [("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")]
    )
    for p, n in enumerate(STATISTICS)
)


@query(
    "e05_invariant_features",
    "WITH" + EMBEDDING_CELLS + "," + stats_sql("unit_id", 3) + _INV + _AGE.format(52, 53, 54),
)
def invariant(spark, base):
    w = features.with_statistics(tb.embedding_windows(spark, base), 16, 4)
    v = w.withColumn("invariant", features.invariant_features("t_end", 100.0, 4))
    out = features.explode_features(v, "invariant", features.invariant_names(), ["unit_id"])
    return rounded(out, ["value"])


@query(
    "e06_direct_sizes",
    "WITH" + WINDOW_CELLS + "," + stats_sql("unit_id, window_index, t_end", EDGE) + """
SELECT unit_id, window_index, CAST(42 AS INTEGER) AS n_features, round(sum(mean), 6) AS mean_sum,
       round(max(t_end) / 86400.0, 6) AS age_ratio FROM stats GROUP BY 1, 2""",
)
def direct_sizes(spark, base):
    w = features.with_statistics(step_windows(spark, base), LENGTH, 3)
    v = w.withColumn("d", features.direct_features("t_end", 86400.0))
    mean_sum = F.get("d", F.lit(9)) + F.get("d", F.lit(10)) + F.get("d", F.lit(11))
    return v.select(
        "unit_id", "window_index", F.size("d").alias("n_features"), F.round(mean_sum, 6).alias("mean_sum"),
        F.round(F.get("d", F.lit(39)), 6).alias("age_ratio"),
    )


@query(
    "a08_feature_normaliser",
    "WITH" + EMBEDDING_CELLS + "," + stats_sql("unit_id", 3)
    + " , f AS (" + " UNION ALL ".join(
        f'SELECT CAST({p} * 4 + c AS INTEGER) AS position, "{n}" AS value FROM stats'
        for p, n in enumerate(STATISTICS)
    ) + """)
SELECT position, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END, 6) AS std
FROM f GROUP BY 1""",
)
def feature_normaliser(spark, base):
    w = features.with_statistics(tb.embedding_windows(spark, base), 16, 4)
    long = w.select(F.posexplode(features.statistic_major()).alias("position", "value"))
    return rounded(stats.fit_feature_normaliser(long), ["mean", "std"])


@query(
    "e07_drop_negative_windows",
    "WITH" + STEPS + """,
w AS (SELECT unit_id, (step - 15) // 4 AS window_index, n_steps - 10 - step AS y FROM st WHERE step >= 15 AND (step - 15) % 4 = 0)
SELECT unit_id, count(*) AS n_windows, count(*) FILTER (y >= 0) AS n_kept, count(*) FILTER (y < 0) AS n_dropped FROM w GROUP BY 1""",
)
def drop_negative(spark, base):
    w = step_windows(spark, base).withColumn("y", F.col("n_steps") - 10 - F.col("end_step"))
    kept = windows.label_allowed("y")
    return w.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped")
    )


@query(
    "e08_running_min",
    "WITH" + STEPS + """
SELECT unit_id, step, min(value) OVER (PARTITION BY unit_id ORDER BY step) AS floor_value FROM st""",
)
def running_min(spark, base):
    axis = tb.event_axis(spark, base)
    out = windows.running_minimum(tb.event_steps(spark, base, axis), axis, "value", "floor_value")
    return out.select("unit_id", "step", "floor_value")


@query(
    "e10_downsample_even",
    "WITH" + STEPS + """,
ix AS (SELECT unit_id, n_steps, CASE WHEN i = 24 THEN n_steps - 1 ELSE CAST(floor(i * ((n_steps - 1) / 24.0)) AS BIGINT) END AS step
       FROM (SELECT DISTINCT unit_id, n_steps FROM st WHERE n_steps > 25) CROSS JOIN range(25) r(i))
SELECT st.unit_id, st.step, st.t, st.value, st.n_steps AS source_points, CAST(25 AS BIGINT) AS display_points
FROM st JOIN (SELECT DISTINCT unit_id, step FROM ix) USING (unit_id, step)
UNION ALL SELECT unit_id, step, t, value, n_steps, n_steps FROM st WHERE n_steps <= 25""",
)
def downsample_even(spark, base):
    axis = tb.event_axis(spark, base)
    out = windows.downsample_even(tb.event_steps(spark, base, axis), axis, 25)
    return out.select(
        "unit_id", F.col("position").alias("step"), "t", "value", "source_points", "display_points"
    )


@query(
    "e11_downsample_until_failure",
    "WITH" + STEPS + """,
s AS (SELECT unit_id, least(greatest(count(*) FILTER (t < 1296000), 1), max(n_steps) - 1) AS stop FROM st GROUP BY 1),
ix AS (SELECT unit_id, stop, CASE WHEN i = 9 THEN stop ELSE CAST(round_even(i * (stop / 9.0), 0) AS BIGINT) END AS step FROM s CROSS JOIN range(10) r(i) WHERE stop + 1 > 10
       UNION ALL SELECT unit_id, stop, step FROM s JOIN st USING (unit_id) WHERE stop + 1 <= 10 AND step <= stop)
SELECT st.unit_id, st.step, st.t, ix.stop FROM st JOIN (SELECT DISTINCT * FROM ix) ix USING (unit_id, step)""",
)
def downsample_until(spark, base):
    axis = tb.event_axis(spark, base)
    st = tb.event_steps(spark, base, axis).withColumn("failure_time", F.lit(1296000.0))
    out = windows.downsample_until(st, axis, "failure_time", 10)
    return out.select("unit_id", F.col("position").alias("step"), "t", "stop")


@query(
    "e12_downsample_stride",
    "WITH" + STEPS + """ SELECT unit_id, step, value FROM st WHERE step % CAST(ceil(n_steps / 20.0) AS BIGINT) = 0""",
)
def downsample_stride(spark, base):
    axis = tb.event_axis(spark, base)
    out = windows.downsample_stride(tb.event_steps(spark, base, axis), axis, 20)
    return out.select("unit_id", F.col("position").alias("step"), "value")


@query(
    "e13_quantile_bin_edges",
    """WITH""" + EMBEDDING_CELLS + """,
o AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY c) AS n FROM cells),
k AS (SELECT c, n, k, k * (100.0 / 32) / 100.0 * (n - 1) AS p FROM (SELECT DISTINCT c, n FROM o) CROSS JOIN range(1, 32) r(k))
SELECT CAST(k.c AS INTEGER) AS feature, k.k - 1 AS edge_index, round((a.v + b.v) * 0.5, 9) AS edge
FROM k JOIN o a ON a.c = k.c AND a.r = floor(k.p) JOIN o b ON b.c = k.c AND b.r = ceil(k.p)""",
)
def quantile_edges(spark, base):
    long = _embedding_values(spark, base)
    return rounded(windows.quantile_edges(long, 32), ["edge"], 9)


def _embedding_values(spark, base):
    w = tb.embedding_windows(spark, base)
    return w.select("unit_id", F.posexplode("x").alias("i", "row")).select(
        "unit_id", "i", F.posexplode("row").alias("feature", "value")
    )


@query(
    "e13_few_values_edges",
    "WITH" + STEPS + """,
d AS (SELECT 'hour' AS feature, hour AS value FROM st GROUP BY 2 UNION ALL SELECT 'k', k FROM st GROUP BY 2),
g AS (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS edge_index FROM d)
SELECT feature, edge_index, (value + nxt) * 0.5 AS edge FROM g WHERE nxt IS NOT NULL""",
)
def few_values_edges(spark, base):
    long = tb.event_steps(spark, base).unpivot([], ["hour", "k"], "feature", "value")
    return windows.quantile_edges(long, 255)


@query(
    "e13_assign_bins",
    "WITH" + STEPS + """,
d AS (SELECT DISTINCT k FROM st), e AS (SELECT (k + lead(k) OVER (ORDER BY k)) * 0.5 AS edge FROM d)
SELECT 'k' AS feature, k AS value, (SELECT count(*) FROM e WHERE e.edge < s.k)::INTEGER AS bin, count(*) AS n FROM st s GROUP BY 1, 2, 3""",
)
def assign_bins(spark, base):
    long = tb.event_steps(spark, base).unpivot([], ["k"], "feature", "value")
    edges = windows.quantile_edges(long, 255)
    counted = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return windows.assign_bins(counted, edges).select("feature", "value", "bin", "n")


@query(
    "e14_history_progress",
    "WITH" + STEPS + """ SELECT unit_id, step, t, value FROM st WHERE step = CAST(floor(0.37 * (n_steps - 1) + 0.5) AS BIGINT)""",
)
def history_progress(spark, base):
    axis = tb.event_axis(spark, base)
    out = windows.row_at_progress(tb.event_steps(spark, base, axis), axis, 0.37)
    return out.select("unit_id", F.col("position").alias("step"), "t", "value")


@query(
    "e15_trend_targets",
    "WITH" + STEPS + """
SELECT unit_id, step, lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2, lead(value, 3) OVER w AS y3,
       lead(value, 3) OVER w IS NOT NULL AS m3 FROM st WINDOW w AS (PARTITION BY unit_id ORDER BY step)""",
)
def trend_targets(spark, base):
    axis = tb.event_axis(spark, base)
    out = windows.trend_targets(tb.event_steps(spark, base, axis), "value", 3, axis=axis)
    y = lambda i: F.get("y_trend", F.lit(i)).alias(f"y{i + 1}")
    return out.select("unit_id", "step", y(0), y(1), y(2), F.get("mask", F.lit(2)).alias("m3"))


@query(
    "s13_explode_sample_arrays",
    """SELECT vec_id AS unit_id, unnest(range(32)) AS sample, CAST(unnest(embedding[1:32]) AS DOUBLE) AS a,
              CAST(unnest(embedding[33:64]) AS DOUBLE) AS b FROM embeddings""",
)
def explode_arrays(spark, base):
    from lifespan.sources.files import explode_sample_arrays

    e = tb.read(spark, base, "embeddings").select(
        F.col("vec_id").alias("unit_id"),
        F.slice("embedding", 1, 32).cast("array<double>").alias("a"),
        F.slice("embedding", 33, 32).cast("array<double>").alias("b"),
    )
    out = explode_sample_arrays(e, ["a", "b"], ["unit_id"])
    return out.withColumn("sample", F.col("sample").cast("bigint"))
