"""Queries for joins, splits, scoring, metrics and policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifespan.fixed_values import MEMBER_SEEDS
from lifespan.functions import scalar as sc
from lifespan.operators import ensemble, evaluate, isotonic, joins, policy, split
from lifespan.operators import segments as sg
from lifespan.plans import scoring
from lifespan.plans.registry import READINGS, STEPS, WINDOW_CELLS, query, stats_sql
from lifespan.plans.window_queries import rounded, step_windows
from lifespan.sources import tables as tb

# -- stand-in predictions: one row per event step ------------------------------
PRED_SQL = STEPS + """,
pr AS (SELECT unit_id, step, t / 86400.0 AS t_end, value / 100.0 - 0.4 AS m17, k / 50.0 - 0.5 AS m42, (value + k) / 150.0 - 0.3 AS m73,
              greatest(0.0, (n_steps - 1 - step) / 4.0) AS y_true FROM st)"""


def predictions(spark, base, axis=None):
    st = tb.event_steps(spark, base, axis)
    return st.select(
        "unit_id",
        "step",
        (F.col("t") / 86400.0).alias("t_end"),
        (F.col("value") / 100.0 - 0.4).alias("m17"),
        (F.col("k") / 50.0 - 0.5).alias("m42"),
        ((F.col("value") + F.col("k")) / 150.0 - 0.3).alias("m73"),
        F.greatest(F.lit(0.0), (F.col("n_steps") - 1 - F.col("step")) / 4.0).alias("y_true"),
    )


def isotonic_sql(source: str, series: list[str], prefix: str = "") -> str:
    """Min-max form of the projection of several columns of ``source (unit_id, i, …)``."""
    stacked = " UNION ALL ".join(f"SELECT unit_id, i, '{s}' AS series, {s} AS v FROM {source}" for s in series)
    return f"""
{prefix}y AS ({stacked}),
{prefix}p AS (SELECT *, sum(v) OVER (PARTITION BY unit_id, series ORDER BY i) AS s FROM {prefix}y),
{prefix}m AS (SELECT a.unit_id, a.series, a.i AS a, b.i AS b, (b.s - a.s + a.v) / (b.i - a.i + 1) AS mean
       FROM {prefix}p a JOIN {prefix}p b ON a.unit_id = b.unit_id AND a.series = b.series AND b.i >= a.i),
{prefix}x AS (SELECT unit_id, series, a, b, max(mean) OVER (PARTITION BY unit_id, series, a ORDER BY b DESC) AS mx FROM {prefix}m),
{prefix}iso AS (SELECT unit_id, series, b AS i, min(mx) AS g FROM {prefix}x GROUP BY 1, 2, 3)"""


@query(
    "e09_isotonic_nonincreasing",
    "WITH" + STEPS + ", src AS (SELECT unit_id, step AS i, value FROM st)," + isotonic_sql("src", ["value"]) + """
SELECT unit_id, i AS step, round(g, 9) AS level FROM iso""",
)
def isotonic_query(spark, base):
    axis = tb.event_axis(spark, base)
    st = tb.event_steps(spark, base, axis).select("unit_id", "step", "value")
    out = isotonic.isotonic_nonincreasing(st, axis.dense("step"), "value", "level")
    return out.select("unit_id", "step", F.round("level", 9).alias("level"))


# -- joins -----------------------------------------------------------------------
@query(
    "j01_reference_predictions",
    """WITH r1 AS (SELECT l_orderkey AS unit_id, l_linenumber AS window_id, arg_max(l_quantity, l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
r2 AS (SELECT l_orderkey AS unit_id, l_linenumber AS window_id, arg_max(l_quantity, l_extendedprice) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT o_orderkey AS unit_id, CAST(o_custkey % 7 + 1 AS INTEGER) AS window_id, o_totalprice AS p50, r1.y AS reference_1, r2.y AS reference_2
FROM orders LEFT JOIN r1 ON r1.unit_id = o_orderkey AND r1.window_id = o_custkey % 7 + 1 LEFT JOIN r2 ON r2.unit_id = o_orderkey AND r2.window_id = o_custkey % 7 + 1""",
)
def reference_predictions(spark, base):
    o = tb.read(spark, base, "orders").select(
        F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 7 + 1).cast("int").alias("window_id"), F.col("o_totalprice").alias("p50")
    )
    li = tb.read(spark, base, "lineitem").withColumnsRenamed({"l_orderkey": "unit_id", "l_linenumber": "window_id"})
    first = li.select("unit_id", "window_id", F.col("l_extendedprice").alias("o"), F.col("l_quantity").alias("y_pred"))
    second = li.where("l_returnflag = 'R'").select("unit_id", "window_id", F.col("l_extendedprice").alias("o"), F.col("l_quantity").alias("y_pred"))
    return joins.join_references(o, first, second, "o")


@query(
    "j02_matched_units",
    "SELECT c_custkey AS unit_id, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def matched_units(spark, base):
    c = tb.read(spark, base, "customer").select(F.col("c_custkey").alias("unit_id"), "c_mktsegment")
    o = tb.read(spark, base, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("unit_id"))
    return joins.matched_units(c, o)


@query(
    "j03_asof_prediction",
    "WITH" + READINGS + """
SELECT p.unit_id, p.row_number, p.t, c.t AS matched_t, c.value AS y_pred FROM (SELECT * FROM ev WHERE channel = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM ev WHERE channel = 'click') c ON c.unit_id = p.unit_id AND p.t >= c.t""",
)
def asof(spark, base):
    ev = tb.event_readings(spark, base)
    p = ev.where("channel = 'purchase'").select("unit_id", "row_number", "t")
    c = ev.where("channel = 'click'").select("unit_id", "row_number", F.col("t").alias("pred_t"), F.col("value").alias("y_pred"))
    return joins.asof_join(p, c, "t", "pred_t", ["y_pred"], tb.event_axis(spark, base))


@query(
    "j04_factor_join",
    """SELECT event_id, value, CASE event_type WHEN 'click' THEN value * 1e-3 WHEN 'error' THEN value * 1e0 WHEN 'view' THEN value * 6e1 WHEN 'signup' THEN value * 36e2 ELSE value * 864e2 END AS seconds FROM events""",
)
def factor_join(spark, base):
    factors = joins.dimension(
        spark,
        [("click", 0.001), ("error", 1.0), ("view", 60.0), ("signup", 3600.0), ("purchase", 86400.0)],
        "event_type string, factor double",
    )
    e = tb.read(spark, base, "events").join(factors, "event_type")
    return e.select("event_id", "value", (F.col("value") * F.col("factor")).alias("seconds"))


@query(
    "j05_holdout_filter",
    "SELECT o_orderkey, o_custkey AS unit_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
def holdout_filter(spark, base):
    o = tb.read(spark, base, "orders").select("o_orderkey", F.col("o_custkey").alias("unit_id"))
    held = tb.read(spark, base, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("unit_id"))
    return joins.without(o, held)


_VERSION_SQL = """WITH s AS (SELECT c_custkey, c_nationkey AS line, CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN '' ELSE 'B' END AS plan,
   CASE WHEN c_acctbal > 5000 THEN 'v2' ELSE 'v1' END AS version FROM customer),
a AS (SELECT n_nationkey AS line, CASE WHEN n_regionkey < 3 THEN 'A' ELSE 'B' END AS ap, 'v1' AS av, n_regionkey = 0 AS ok FROM nation),
c AS (SELECT c_custkey, CASE WHEN plan = '' THEN 'unknown' WHEN plan = ap AND version = av THEN 'current' WHEN ok AND plan = 'B' AND ap = 'A' THEN 'role-separated' ELSE 'mismatch' END AS state
      FROM s LEFT JOIN a USING (line))"""


def _versions(spark, base):
    c = tb.read(spark, base, "customer")
    samples = c.select(
        "c_custkey", F.col("c_nationkey").alias("line"),
        F.when(F.col("c_mktsegment") == "BUILDING", "A").when(F.col("c_mktsegment") == "MACHINERY", "").otherwise("B").alias("plan"),
        F.when(F.col("c_acctbal") > 5000, "v2").otherwise("v1").alias("version"),
    )
    active = tb.read(spark, base, "nation").select(
        F.col("n_nationkey").alias("line"), F.when(F.col("n_regionkey") < 3, "A").otherwise("B").alias("active_plan"),
        F.lit("v1").alias("active_version"), (F.col("n_regionkey") == 0).alias("roles_valid"),
    )
    return joins.version_compare(samples, active)


@query("j06_version_compare", _VERSION_SQL + " SELECT * FROM c")
def version_compare(spark, base):
    return _versions(spark, base).select("c_custkey", "state")


@query("a18_state_counts", _VERSION_SQL + " SELECT state, count(*) AS n FROM c GROUP BY 1")
def state_counts(spark, base):
    return evaluate.state_counts(_versions(spark, base))


@query("a18_state_members", _VERSION_SQL + " SELECT state, c_custkey FROM c WHERE state IN ('mismatch', 'role-separated')")
def state_members(spark, base):
    return evaluate.state_members(_versions(spark, base), ["mismatch", "role-separated"], "c_custkey")


@query(
    "j07_zone_of",
    """SELECT event_id, CASE WHEN value / 200 < 0.6 THEN 'nominal' WHEN value / 200 < 0.85 THEN 'caution' WHEN value / 200 < 1.5 THEN 'critical' END AS zone FROM events""",
)
def zone_of(spark, base):
    return tb.read(spark, base, "events").select("event_id", sc.zone_of(F.col("value") / 200).alias("zone"))


@query(
    "j08_attach_label",
    "WITH" + WINDOW_CELLS + """ SELECT w.unit_id, w.window_index, w.end_step, s.n_steps - 1 - s.step AS y FROM win w JOIN st s ON s.unit_id = w.unit_id AND s.step = w.end_step""",
)
def attach_label(spark, base):
    st = tb.event_steps(spark, base).withColumn("rul", F.col("n_steps") - 1 - F.col("step"))
    w = step_windows(spark, base).select("unit_id", "window_index", "end_step")
    return joins.attach_label(w, st, "end_step", "step", "rul")


# -- splits ------------------------------------------------------------------------
_SPLIT_SQL = """WITH h AS (SELECT c_custkey AS unit_id, c_mktsegment AS cell, c_acctbal < 0 AS held, sha256('0:' || c_custkey) AS d FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d) - 1 AS rk, count(*) OVER (PARTITION BY cell) AS n FROM h WHERE NOT held),
sp AS (SELECT unit_id, cell, CASE WHEN n > 1 AND rk >= n - greatest(1, least(CAST(floor(n * 2e-1) AS BIGINT), n - 1)) THEN 'val' ELSE 'train' END AS split FROM r
       UNION ALL SELECT unit_id, cell, 'holdout' FROM h WHERE held)"""


def _split(spark, base):
    c = tb.read(spark, base, "customer")
    units = c.select(F.col("c_custkey").alias("unit_id"), F.col("c_mktsegment").alias("cell"))
    held = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("unit_id"))
    return split.cell_tail_split(units, "cell", 0.2, 0, held)


@query("t01_cell_tail_split", _SPLIT_SQL + " SELECT * FROM sp")
def cell_tail_split(spark, base):
    return _split(spark, base)


@query(
    "t02_split_differences",
    _SPLIT_SQL + """ SELECT unit_id, cell, split, 'computed' AS only_in FROM sp WHERE cell = 'FURNITURE' AND split = 'val'
UNION ALL SELECT unit_id, cell, 'train', 'recorded' FROM sp WHERE cell = 'FURNITURE' AND split = 'val'""",
)
def split_differences(spark, base):
    sp = _split(spark, base)
    moved = F.when((F.col("cell") == "FURNITURE") & (F.col("split") == "val"), "train").otherwise(F.col("split"))
    return split.split_differences(sp, sp.withColumn("split", moved))


@query(
    "t03_sample_rows",
    "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY sha256('7:' || o_orderkey)) AS r FROM orders) WHERE r <= 500",
)
def sample_rows(spark, base):
    return split.sample_rows(tb.read(spark, base, "orders").select("o_orderkey", "o_totalprice"), 500, 7, "o_orderkey")





@query(
    "t04_route_units",
    """WITH x AS (SELECT o_custkey AS unit_id, list(DISTINCT o_orderpriority) AS have FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1),
h AS (SELECT DISTINCT o_custkey AS unit_id, coalesce(have, []) AS have FROM orders LEFT JOIN x ON x.unit_id = o_custkey),
b AS (SELECT unit_id, list_contains(have, '1-URGENT') AND list_contains(have, '2-HIGH') AS bat, list_contains(have, '3-MEDIUM') AS rw FROM h)
SELECT unit_id, CASE WHEN NOT bat AND NOT rw THEN 'unsupported_telemetry_set' WHEN bat AND rw THEN 'ambiguous_product_line' WHEN bat THEN 'battery' ELSE 'wheel' END AS automatic,
       CASE WHEN NOT bat AND NOT rw THEN 'unsupported_telemetry_set' WHEN bat AND rw THEN 'wheel' WHEN bat THEN 'line_mismatch' ELSE 'wheel' END AS wheel_only FROM b""",
)
def route_units(spark, base):
    o = tb.read(spark, base, "orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("channel"))
    have = split.unit_channels(o, ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    routes = {"battery": [["1-URGENT", "2-HIGH"]], "wheel": [["3-MEDIUM"]]}
    return have.select(
        "unit_id",
        split.route_state(F.col("have"), routes).alias("automatic"),
        split.route_state(F.col("have"), routes, "wheel").alias("wheel_only"),
    )


@query(
    "t05_ignored_channels",
    "SELECT DISTINCT user_id AS unit_id, event_type AS channel FROM events WHERE event_type NOT IN ('click', 'view')",
)
def ignored_channels(spark, base):
    return split.ignored_channels(tb.event_readings(spark, base), ["click", "view"])


@query(
    "t06_top_k_rows",
    "WITH" + STEPS + " SELECT unit_id, step, t, value FROM st WHERE step < 5",
)
def top_k(spark, base):
    rows = tb.event_rows(spark, base).select("unit_id", "t", "row_number", "value")
    return sg.top_rows(rows, ["unit_id"], ["t", "row_number"], 5, "step").select("unit_id", "step", "t", "value")


@query(
    "t07_union_train_val",
    _SPLIT_SQL + " SELECT unit_id, cell, 'fit' AS part FROM sp WHERE split IN ('train', 'val')",
)
def union_train_val(spark, base):
    sp = _split(spark, base)
    out = sp.where("split = 'train'").unionByName(sp.where("split = 'val'"))
    return out.select("unit_id", "cell", F.lit("fit").alias("part"))


@query(
    "t08_set_operations",
    """SELECT 'both' AS part, c FROM (SELECT c_nationkey AS c FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customer_only', c FROM (SELECT c_nationkey AS c FROM customer EXCEPT SELECT s_nationkey FROM supplier)""",
)
def set_operations(spark, base):
    a = tb.read(spark, base, "customer").select(F.col("c_nationkey").alias("c"))
    b = tb.read(spark, base, "supplier").select(F.col("s_nationkey").alias("c"))
    both = a.intersect(b).select(F.lit("both").alias("part"), "c")
    return both.unionByName(a.subtract(b).select(F.lit("customer_only").alias("part"), "c"))


# -- ensemble ------------------------------------------------------------------------
@query(
    "m05_age_blend",
    "WITH" + PRED_SQL + """ SELECT unit_id, step, round(CASE WHEN t_end <= 15 THEN 0.2 * m17 + 0.8 * m42 ELSE 0.7 * m17 + 0.3 * m42 END, 6) AS blend FROM pr""",
)
def age_blend(spark, base):
    blend = ensemble.age_blend(F.col("m17"), F.col("m42"), F.col("t_end"), 15.0, 0.2, 0.7)
    return predictions(spark, base).select("unit_id", "step", F.round(blend, 6).alias("blend"))


@query(
    "m06_aggregate_members",
    "WITH" + PRED_SQL + """ SELECT unit_id, step, round(CASE WHEN count(v) = 3 THEN quantile_cont(v, 0.5) END, 6) AS median3, round(CASE WHEN count(v) = 3 THEN avg(v) END, 6) AS mean3, round(max(v) FILTER (seed = 17), 6) AS seed17,
 count(*) = 3 AS complete FROM (SELECT unit_id, step, unnest([17, 42, 73]) AS seed, unnest([m17, m42, m73]) AS v FROM pr) WHERE NOT (seed = 73 AND v > 1.5) GROUP BY 1, 2""",
)
def aggregate_members(spark, base):
    p = predictions(spark, base)
    long = p.unpivot(["unit_id", "step"], ["m17", "m42", "m73"], "name", "y_norm").withColumn(
        "seed", F.substring("name", 2, 2).cast("int")
    ).where("not (seed = 73 and y_norm > 1.5)")
    wide = ensemble.members_wide(long, ["unit_id", "step"])
    median, mean = (ensemble.aggregate_members(m) for m in ("median3", "mean3"))
    return wide.select(
        "unit_id", "step", F.round(median, 6).alias("median3"), F.round(mean, 6).alias("mean3"),
        F.round(ensemble.aggregate_members("seed17"), 6).alias("seed17"), "complete",
    )


_FINISH_SQL = ", src AS (SELECT unit_id, step AS i, m17, m42, m73, list_sort([m17, m42, m73])[2] AS raw FROM pr)," + isotonic_sql(
    "src", ["raw", "m17", "m42", "m73"]
) + """,
sf AS (SELECT unit_id, i, series, greatest(0.0, least(1.0, g)) * 20 AS v FROM iso),
w AS (SELECT unit_id, i, max(v) FILTER (series = 'raw') AS point, quantile_cont(v, 0.1) FILTER (series <> 'raw') AS q10,
             quantile_cont(v, 0.9) FILTER (series <> 'raw') AS q90, stddev_pop(v) FILTER (series <> 'raw') AS sd FROM sf GROUP BY 1, 2),
fin AS (SELECT w.unit_id, w.i AS step, raw * 20 AS y_pred_raw, point AS y_pred, abs(raw * 20 - point) > 1e-9 AS clamped, least(q10, point) AS p10,
               greatest(q90, point) AS p90, sd AS ensemble_std FROM w JOIN src USING (unit_id, i))"""


def _finished(spark, base):
    axis = tb.event_axis(spark, base)
    return ensemble.finish(predictions(spark, base, axis), axis.dense("step"), 20.0)


@query(
    "m07_project_and_clip",
    "WITH" + PRED_SQL + _FINISH_SQL + " SELECT unit_id, step, round(y_pred_raw, 9) AS y_pred_raw, round(y_pred, 9) AS y_pred, clamped FROM fin",
)
def project_and_clip(spark, base):
    return rounded(_finished(spark, base).select("unit_id", "step", "y_pred_raw", "y_pred", "clamped"), ["y_pred_raw", "y_pred"], 9)


@query(
    "m07_bound_violations",
    "WITH" + PRED_SQL + _FINISH_SQL + """ SELECT count(*) FILTER (y_pred_raw < -2e-5) AS low_violations, count(*) FILTER (y_pred_raw > 20 + 2e-5) AS high_violations,
 count(*) FILTER (clamped) AS clamped_rows FROM fin""",
)
def bound_violations(spark, base):
    return ensemble.bound_violations(_finished(spark, base), "y_pred_raw", 20.0)


@query(
    "m08_member_interval",
    "WITH" + PRED_SQL + _FINISH_SQL + " SELECT unit_id, step, round(p10, 9) AS p10, round(p90, 9) AS p90, round(ensemble_std, 9) AS ensemble_std FROM fin",
)
def member_interval(spark, base):
    return rounded(_finished(spark, base).select("unit_id", "step", "p10", "p90", "ensemble_std"), ["p10", "p90", "ensemble_std"], 9)


@query(
    "m07_running_min_mode",
    "WITH" + PRED_SQL + """ SELECT unit_id, step, round(greatest(0.0, least(1.0, min(m17) OVER (PARTITION BY unit_id ORDER BY step))) * 20, 6) AS y_pred FROM pr""",
)
def running_min_mode(spark, base):
    axis = tb.event_axis(spark, base)
    out = ensemble.finish(predictions(spark, base, axis), axis.dense("step"), 20.0, "seed17", "causal_running_min")
    return rounded(out.select("unit_id", "step", "y_pred"), ["y_pred"])


# -- flagship ------------------------------------------------------------------------
PLAN = scoring.ScoringPlan(
    channels=tb.STEP_CHANNELS, length=16, stride=4, rmax=20.0, age_threshold=15.0, low_weight=0.2, high_weight=0.7
)
OFFSETS = dict(zip(MEMBER_SEEDS, (-0.10, 0.0, 0.15)))


def closed_form(windowed):
    """Three deterministic members from window statistics, standing in for fitted models."""
    members = {}
    for seed, offset in OFFSETS.items():
        members[f"direct_{seed}"] = F.expr(
            f"1d / (1d + exp(-(({offset}d) + 0.8d * stats[0].slope - 0.3d * stats[1].tail_mean + 0.2d * stats[0].std)))"
        )
        members[f"tree_{seed}"] = F.expr(
            f"1.1d - age / age_scale + ({offset}d) * stats[0].mean + 0.1d * (stats[1].q75 - stats[1].q25)"
        )
    return windowed.withColumns(members)


def flagship_steps(spark, base, axis):
    """Numbered steps with age, true remaining life, and the scale and statistics of training units."""
    rows = tb.event_rows(spark, base).withColumn("age", F.col("t") / 86400.0)
    train = rows.where(split.digest(0) < "d")
    fitted = scoring.step_statistics(train, PLAN.channels, F.max("age").alias("age_scale"))
    steps = sg.unit_values(sg.row_numbers(rows, axis, "step"), axis, {"life": (F.max("age"), F.max)})
    steps = steps.withColumn("y_true", F.col("life") - F.col("age")).drop("life", "row_number")
    return scoring.normalise_steps(steps, fitted, PLAN.channels)


def predict_events(spark, base, axis):
    return scoring.predict_batch(flagship_steps(spark, base, axis), PLAN, closed_form, axis.dense("window_index"))


def _flag_members() -> str:
    parts = []
    for seed, o in OFFSETS.items():
        direct = f"1.0 / (1.0 + exp(-({o} + 0.8 * sl0 - 0.3 * tail1 + 0.2 * sd0)))"
        tree = f"(1.1 - age / age_scale + ({o}) * mean0 + 0.1 * (q751 - q251))"
        parts.append(f"(1 - w) * {tree} + w * ({direct}) AS m{seed}")
    return ", ".join(parts)


FLAGSHIP_SQL = STEPS + """,
lf AS (SELECT unit_id, max(t / 86400.0) AS life FROM st GROUP BY 1),
tr AS (SELECT *, t / 86400.0 AS age FROM st WHERE sha256('0:' || unit_id) < 'd'),
f AS (SELECT avg(value) AS a0, stddev_pop(value) AS d0, avg(k) AS a1, stddev_pop(k) AS d1, avg(hour) AS a2, stddev_pop(hour) AS d2, max(age) AS age_scale FROM tr),
nz AS (SELECT unit_id, step, t, (value - a0) / d0 AS z0, (k - a1) / d1 AS z1, (hour - a2) / d2 AS z2, age_scale FROM st CROSS JOIN f),
win AS (SELECT unit_id, (step - 15) // 4 AS window_index, step AS end_step, t AS t_end, age_scale FROM nz WHERE step >= 15 AND (step - 15) % 4 = 0),
cells AS (SELECT w.unit_id, w.window_index, w.t_end, w.age_scale, s.step - w.end_step + 15 AS i, unnest([0, 1, 2]) AS c, unnest([s.z0, s.z1, s.z2]) AS v
          FROM win w JOIN nz s ON s.unit_id = w.unit_id AND s.step BETWEEN w.end_step - 15 AND w.end_step),""" + stats_sql(
    "unit_id, window_index, t_end, age_scale", 3
) + """,
wd AS (SELECT unit_id, window_index, t_end, t_end / 86400.0 AS age, age_scale, CASE WHEN t_end / 86400.0 <= 15 THEN 0.2 ELSE 0.7 END AS w,
              max(slope) FILTER (c = 0) AS sl0, max(std) FILTER (c = 0) AS sd0, max(mean) FILTER (c = 0) AS mean0,
              max(tail_mean) FILTER (c = 1) AS tail1, max(q75) FILTER (c = 1) AS q751, max(q25) FILTER (c = 1) AS q251 FROM stats GROUP BY ALL),
mb AS (SELECT unit_id, window_index AS i, t_end, age, """ + _flag_members() + """ FROM wd),
src AS (SELECT *, list_sort([m17, m42, m73])[2] AS raw FROM mb),""" + isotonic_sql("src", ["raw", "m17", "m42", "m73"]) + """,
sf AS (SELECT unit_id, i, series, greatest(0.0, least(1.0, g)) * 20 AS v FROM iso),
q AS (SELECT unit_id, i, max(v) FILTER (series = 'raw') AS point, quantile_cont(v, 0.1) FILTER (series <> 'raw') AS q10,
             quantile_cont(v, 0.9) FILTER (series <> 'raw') AS q90, stddev_pop(v) FILTER (series <> 'raw') AS sd FROM sf GROUP BY 1, 2),
res AS (SELECT q.unit_id, q.i AS window_index, src.t_end, life - age AS y_true, raw * 20 AS y_pred_raw, point AS y_pred,
               abs(raw * 20 - point) > 1e-9 AS clamped, least(q10, point) AS p10, greatest(q90, point) AS p90, sd AS ensemble_std
        FROM q JOIN src USING (unit_id, i) JOIN lf USING (unit_id))"""
_FLAG_COLS = ["y_true", "y_pred_raw", "y_pred", "p10", "p90", "ensemble_std"]


@query(
    "m10_predict_batch",
    "WITH" + FLAGSHIP_SQL + " SELECT unit_id, window_index, t_end, clamped, " + ", ".join(f"round({c}, 5) AS {c}" for c in _FLAG_COLS) + " FROM res",
)
def predict_batch(spark, base):
    out = predict_events(spark, base, tb.event_axis(spark, base))
    return rounded(out.drop("m17", "m42", "m73"), _FLAG_COLS, 5)


@query(
    "m10_predict_metrics",
    "WITH" + FLAGSHIP_SQL + """, e AS (SELECT *, y_pred - y_true AS er, lag(y_pred) OVER (PARTITION BY unit_id ORDER BY window_index) AS pp FROM res),
u AS (SELECT unit_id, sqrt(avg(er * er)) AS ur FROM e GROUP BY 1)
SELECT round(sqrt(avg(er * er)), 5) AS rmse, round(avg(abs(er)), 5) AS mae, round(avg(er), 5) AS bias, round((SELECT avg(ur) FROM u), 5) AS unit_macro_rmse,
 count(*) FILTER (y_pred > pp + 1e-9) / count(pp) AS upward_fraction, count(*) AS n_windows, count(DISTINCT unit_id) AS n_units FROM e""",
)
def predict_metrics(spark, base):
    axis = tb.event_axis(spark, base)
    out = evaluate.regression_metrics(predict_events(spark, base, axis), axis.dense("window_index"))
    return rounded(out, ["rmse", "mae", "bias", "unit_macro_rmse"], 5)


# -- metrics -----------------------------------------------------------------------
@query(
    "a12_regression_metrics",
    "WITH" + PRED_SQL + """, e AS (SELECT unit_id, m17 * 20 - y_true AS er, m17 * 20 AS p, lag(m17 * 20) OVER (PARTITION BY unit_id ORDER BY step) AS pp FROM pr),
u AS (SELECT unit_id, sqrt(avg(er * er)) AS ur FROM e GROUP BY 1)
SELECT round(sqrt(avg(er * er)), 6) AS rmse, round(avg(abs(er)), 6) AS mae, round(avg(er), 6) AS bias, round((SELECT avg(ur) FROM u), 6) AS unit_macro_rmse,
 round(count(*) FILTER (p > pp + 1e-9) / count(pp), 9) AS upward_fraction, count(*) AS n_windows, count(DISTINCT unit_id) AS n_units FROM e""",
)
def regression_metrics(spark, base):
    axis = tb.event_axis(spark, base)
    p = predictions(spark, base, axis).withColumn("y_pred", F.col("m17") * 20)
    out = evaluate.regression_metrics(p, axis.dense("step"))
    return rounded(rounded(out, ["rmse", "mae", "bias", "unit_macro_rmse"]), ["upward_fraction"], 9)


@query(
    "a13_smooth_l1",
    "WITH" + PRED_SQL + " SELECT round(avg(CASE WHEN abs(m17 - m42) < 1 THEN 0.5 * (m17 - m42) * (m17 - m42) ELSE abs(m17 - m42) - 0.5 END), 6) AS loss FROM pr",
)
def smooth_l1(spark, base):
    return predictions(spark, base).agg(F.round(evaluate.smooth_l1(F.col("m17"), F.col("m42")), 6).alias("loss"))


@query(
    "a14_seed_metric_summary",
    """WITH r AS (SELECT event_type AS component, CAST(user_id AS VARCHAR) AS seed, max(value) / 500 AS score, 'val' AS split FROM events GROUP BY 1, 2),
d AS (SELECT component, seed, score FROM r WHERE score BETWEEN 0 AND 1),
x AS (SELECT component, seed, min(score) AS lo, max(score) AS hi FROM (SELECT * FROM d UNION ALL SELECT component, seed, score / 2 FROM d WHERE component = 'view') GROUP BY 1, 2)
SELECT component, round(avg(lo), 12) AS mean, min(lo) AS minimum, max(lo) AS maximum, count(*) AS seed_count FROM x GROUP BY 1 HAVING bool_and(lo = hi)""",
)
def seed_metric_summary(spark, base):
    e = tb.read(spark, base, "events").groupBy(F.col("event_type").alias("component"), F.col("user_id").cast("string").alias("seed")).agg(
        (F.max("value") / 500).alias("score")
    )
    rows = e.select("component", "seed", "score", F.lit(" VAL").alias("split"), F.lit("True").alias("adopted"))
    noise = rows.withColumn("adopted", F.lit("no")).withColumn("score", F.col("score") / 3)
    clash = rows.where("component = 'view'").withColumn("score", F.col("score") / 2)
    return evaluate.seed_metric_summary(rows.unionByName(noise).unionByName(clash), "score")


_COMPONENT_SQL = """WITH m AS (SELECT o_orderpriority AS component, o_orderstatus AS model, stddev_pop(o_totalprice) AS rmse, avg(o_totalprice) / 10 AS mae FROM orders GROUP BY 1, 2)"""


def _component_metrics(spark, base):
    return tb.read(spark, base, "orders").groupBy(F.col("o_orderpriority").alias("component"), F.col("o_orderstatus").alias("model")).agg(
        F.stddev_pop("o_totalprice").alias("rmse"), (F.avg("o_totalprice") / 10).alias("mae")
    )


@query(
    "a15_metric_delta",
    _COMPONENT_SQL + """ SELECT a.component, round(a.rmse, 4) AS baseline, round(b.rmse, 4) AS adapted, round(a.rmse - b.rmse, 4) AS change
FROM m a JOIN m b USING (component) WHERE a.model = 'O' AND b.model = 'F'""",
)
def metric_delta(spark, base):
    m = _component_metrics(spark, base)
    out = evaluate.metric_delta(m.where("model = 'O'"), m.where("model = 'F'"))
    return rounded(out, ["baseline", "adapted", "change"], 4)


@query(
    "a16_release_gate",
    _COMPONENT_SQL + ", l AS (SELECT component, avg(rmse) AS x, avg(mae) AS y FROM m GROUP BY 1) SELECT component, model, rmse <= x AND mae <= y AS passed FROM m JOIN l USING (component)",
)
def release_gate(spark, base):
    m = _component_metrics(spark, base)
    limits = m.groupBy("component").agg(F.avg("rmse").alias("max_rmse"), F.avg("mae").alias("max_mae"))
    return evaluate.release_gate(m, limits).select("component", "model", "passed")


@query(
    "a17_select_best_model",
    _COMPONENT_SQL + " SELECT component, arg_min(model, rmse) AS model, round(min(rmse), 4) AS rmse FROM m GROUP BY 1",
)
def select_best(spark, base):
    return rounded(evaluate.select_best(_component_metrics(spark, base)), ["rmse"], 4)


@query(
    "a19_bundle_by_unit",
    "WITH" + STEPS + """ SELECT unit_id, step // 20 AS part, n_steps AS unit_rows, string_agg(step || ':' || row_number, ',' ORDER BY step) AS rows FROM st GROUP BY 1, 2, 3""",
)
def bundle_by_unit(spark, base):
    axis = tb.event_axis(spark, base)
    st = tb.event_steps(spark, base, axis)
    out = evaluate.bundle_by_unit(st, axis, ["step", "row_number"], 20)
    text = F.transform("rows", lambda r: F.concat_ws(":", r["step"].cast("string"), r["row_number"].cast("string")))
    return out.select("unit_id", "part", "unit_rows", F.array_join(text, ",").alias("rows"))


@query(
    "a20_batch_status",
    """SELECT o_custkey AS batch, count(*) AS submitted, count(*) FILTER (o_orderstatus <> 'P') AS predicted, count(*) FILTER (o_orderstatus = 'P') AS rejected,
 CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'complete' WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN 'partial' ELSE 'rejected' END AS status FROM orders GROUP BY 1""",
)
def batch_status(spark, base):
    o = tb.read(spark, base, "orders").select(F.col("o_custkey").alias("batch"), (F.col("o_orderstatus") != "P").alias("predicted"))
    return evaluate.batch_status(o)


@query("a21_age_scale", "WITH" + READINGS + " SELECT max(t) AS age_scale FROM ev WHERE sha256('0:' || unit_id) < 'd'")
def age_scale(spark, base):
    return evaluate.age_scale(tb.event_readings(spark, base).where(split.digest(0) < "d"), "t")


@query(
    "a22_epoch_median",
    "SELECT c_mktsegment AS component, CAST(floor(quantile_cont(c_nationkey, 0.5)) AS INTEGER) AS epochs FROM customer GROUP BY 1",
)
def epoch_median(spark, base):
    c = tb.read(spark, base, "customer").select(F.col("c_mktsegment").alias("component"), F.col("c_nationkey").alias("epochs"))
    return evaluate.epoch_median(c)


@query(
    "a23_interval_coverage",
    "WITH" + PRED_SQL + """ SELECT unit_id, round(avg(CASE WHEN y_true BETWEEN least(m17, m42) * 20 AND greatest(m17, m42) * 20 THEN 1 ELSE 0 END), 6) AS coverage,
 round(avg(greatest(m17, m42) * 20 - least(m17, m42) * 20), 6) AS mean_width FROM pr GROUP BY 1""",
)
def interval_coverage(spark, base):
    p = predictions(spark, base).select(
        "unit_id", "y_true", (F.least("m17", "m42") * 20).alias("p10"), (F.greatest("m17", "m42") * 20).alias("p90")
    )
    return rounded(evaluate.interval_coverage(p, ["unit_id"]), ["coverage", "mean_width"])


@query(
    "a24_alpha_lambda",
    "WITH" + PRED_SQL + """, i AS (SELECT unit_id, t_end, abs(y_true * (1 + (m17 - 0.1) / 3) - y_true) <= 0.2 * y_true AS ok FROM pr),
u AS (SELECT unit_id, avg(CASE WHEN ok THEN 1 ELSE 0 END) AS accuracy, max(t_end) FILTER (NOT ok) AS lo, max(t_end) AS life FROM i GROUP BY 1),
s AS (SELECT i.unit_id, min(t_end) AS start FROM i JOIN u USING (unit_id) WHERE lo IS NULL OR t_end > lo GROUP BY 1)
SELECT u.unit_id, round(accuracy, 6) AS accuracy, round(1 - start / life, 6) AS horizon FROM u LEFT JOIN s USING (unit_id)""",
)
def alpha_lambda(spark, base):
    p = predictions(spark, base).withColumn("y_pred", F.col("y_true") * (1 + (F.col("m17") - 0.1) / 3))
    return rounded(evaluate.alpha_lambda(p), ["accuracy", "horizon"])


@query(
    "a27_metrics_by_split",
    """WITH l AS (SELECT c_nationkey AS component, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'validation' ELSE 'holdout' END AS split,
   stddev_pop(c_acctbal) AS rmse, avg(abs(c_acctbal)) AS mae, count(*) AS n, CASE WHEN min(c_acctbal) < -990 THEN 'fail' ELSE 'pass' END AS status FROM customer GROUP BY 1, 2)
SELECT component, round(max(rmse) FILTER (split = 'validation'), 4) AS validation_rmse, round(max(mae) FILTER (split = 'validation'), 4) AS validation_mae,
 max(n) FILTER (split = 'validation') AS validation_n_windows, max(n) FILTER (split = 'validation') AS validation_n_units,
 round(max(rmse) FILTER (split = 'holdout'), 4) AS holdout_rmse, round(max(mae) FILTER (split = 'holdout'), 4) AS holdout_mae,
 max(n) FILTER (split = 'holdout') AS holdout_n_windows, max(n) FILTER (split = 'holdout') AS holdout_n_units,
 bool_and(status = 'pass') AND count(DISTINCT split) = 2 AS available FROM l GROUP BY 1""",
)
def metrics_by_split(spark, base):
    c = tb.read(spark, base, "customer")
    part = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "validation").otherwise("holdout")
    led = c.groupBy(F.col("c_nationkey").alias("component"), part.alias("split")).agg(
        F.stddev_pop("c_acctbal").alias("rmse"), F.avg(F.abs("c_acctbal")).alias("mae"),
        F.count(F.lit(1)).alias("n_windows"), F.count(F.lit(1)).alias("n_units"),
        F.when(F.min("c_acctbal") < -990, "fail").otherwise("pass").alias("status"),
    )
    out = evaluate.metrics_by_split(led)
    return rounded(out, [f"{s}_{m}" for s in ("validation", "holdout") for m in ("rmse", "mae")], 4)


# -- policy ------------------------------------------------------------------------
@query(
    "m11_risk_state",
    "WITH" + PRED_SQL + """, f AS (SELECT unit_id, arg_min(m17 * 20, step) AS first_p10 FROM pr WHERE m17 > -0.3 GROUP BY 1)
SELECT u.unit_id, round(first_p10, 6) AS first_p10, CASE WHEN first_p10 IS NULL THEN 'unknown' WHEN first_p10 <= 5 * 0.45 THEN 'critical' WHEN first_p10 <= 5 THEN 'caution' ELSE 'nominal' END AS risk
FROM (SELECT DISTINCT unit_id FROM pr) u LEFT JOIN f USING (unit_id)""",
)
def risk_state(spark, base):
    p = predictions(spark, base).withColumn("p10", F.when(F.col("m17") > -0.3, F.col("m17") * 20))
    return rounded(policy.risk_state(p, 5.0, ["step"]), ["first_p10"])


@query(
    "m12_maintenance_slack",
    "WITH" + PRED_SQL + " SELECT unit_id, step, round(CASE WHEN m17 > -0.3 THEN greatest(0.0, m17 * 20 - 5) END, 6) AS slack FROM pr",
)
def maintenance_slack(spark, base):
    p = predictions(spark, base).withColumn("p10", F.when(F.col("m17") > -0.3, F.col("m17") * 20))
    out = policy.maintenance_slack(p, 5.0)
    return rounded(out.select("unit_id", "step", "slack"), ["slack"])


@query(
    "m13_replay_state",
    """WITH t AS (SELECT c_custkey AS unit_id, c_acctbal >= 0 AS f FROM customer), p AS (SELECT o_custkey AS unit_id, bool_or(o_totalprice > 300000) AS f FROM orders GROUP BY 1)
SELECT unit_id, coalesce(t.f, false) AS has_telemetry, coalesce(p.f, false) AS has_prediction, CASE WHEN coalesce(t.f, false) OR coalesce(p.f, false) THEN 'ready' ELSE 'unavailable' END AS state
FROM t FULL JOIN p USING (unit_id)""",
)
def replay_state(spark, base):
    t = tb.read(spark, base, "customer").select(
        F.col("c_custkey").alias("unit_id"), F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal")).alias("value")
    )
    p = tb.read(spark, base, "orders").select(
        F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").cast("double").alias("t_end"),
        F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("p50"), F.lit(None).cast("double").alias("y_true"),
    )
    return policy.replay_state(t, p, ["p50", "y_true"])


@query(
    "m14_comparable_series",
    "WITH" + PRED_SQL + """ SELECT unit_id, unnest(['m17', 'm42', 'm73']) AS series, unnest([bool_or(m17 > 2), bool_or(m42 > 1.4), true]) AS comparable FROM pr GROUP BY 1""",
)
def comparable_series(spark, base):
    p = predictions(spark, base).select(
        "unit_id", "y_true", F.when(F.col("m17") > 2, F.col("m17")).alias("m17"), F.when(F.col("m42") > 1.4, F.col("m42")).alias("m42"), "m73"
    )
    return policy.comparable_series(p, ["m17", "m42", "m73"])
