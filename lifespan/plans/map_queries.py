"""Queries for names, values, times, layouts, identifiers, orbits and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.functions import scalar as sc
from lifespan.operators import evaluate, joins, mapping
from lifespan.operators import segments as sg
from lifespan.plans.registry import READINGS, STEPS, SUPPLIER_DAYS, query
from lifespan.plans.window_queries import rounded
from lifespan.sources import delimited, files, fixtures, packed, records, runs, storage
from lifespan.sources import tables as tb


# -- names and headers ---------------------------------------------------------
@query(
    "p01_normalise_name",
    """SELECT p_partkey, regexp_replace(lower(trim(label)), '[\\s_.\\-/:()\\[\\]{}]+', '', 'g') AS name_key, regexp_replace(lower(trim(label)), '\\s+', '', 'g') AS header_key
FROM (SELECT p_partkey, ' ' || p_name || '_(' || p_brand || ') [' || p_type || ']' AS label FROM part)""",
)
def normalise_name(spark, base):
    p = tb.read(spark, base, "part")
    label = F.concat(F.lit(" "), "p_name", F.lit("_("), "p_brand", F.lit(") ["), "p_type", F.lit("]"))
    rows = p.select("p_partkey", label.alias("label"))
    loose = mapping.normalise_names(rows, "label", "name_key")
    return mapping.normalise_names(loose, "label", "header_key", strict=True).select("p_partkey", "name_key", "header_key")


@query("p01_compatibility_form", "SELECT conv_id, turn, 'AB' || role AS plain FROM conversations")
def compatibility_form(spark, base):
    d = tb.read(spark, base, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("ＡＢ"), "role").alias("wide"))
    return mapping.with_nfkc(d, "wide", "plain").select("conv_id", "turn", "plain")


@query(
    "p02_resolve_aliases",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'bat.capacity_ah' WHEN 'error' THEN 'rw.speed_rpm' WHEN 'view' THEN 'bat.temp_mean_c' WHEN 'signup' THEN 'rw.motor_current_a' ELSE 'unknown:Purchase Total' END AS canonical FROM events""",
)
def resolve_aliases(spark, base):
    spelled = {"click": "ｂａｔｔｅｒｙ＿capacity_ah", "error": "Wheel-Speed (RPM)", "view": "电池温度（℃）", "signup": "电机电流(A)", "purchase": "Purchase Total"}
    names = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])
    e = tb.read(spark, base, "events").select("event_id", names[F.col("event_type")].alias("label"))
    return mapping.resolve_channels(spark, e, "label", "canonical").select("event_id", "canonical")


_HEADER_SETS = {
    "AUTOMOBILE": ["time_s", "channel", "value", "component_id"],
    "BUILDING": ["Cycle", "bat.capacity_ah", "bat.temp_mean_c", "bat.charge_time_s"],
    "FURNITURE": ["time", "value", "bat.capacity_ah"],
    "HOUSEHOLD": ["time", "telemetry", "value", "wheel_speed_rpm"],
    "MACHINERY": ["time_h", "a", "b", "A "],
}


def _file_columns(spark, base):
    c = tb.read(spark, base, "customer")
    sets = F.create_map(*[x for k, v in _HEADER_SETS.items() for x in (F.lit(k), F.array(*[F.lit(h) for h in v]))])
    return c.select(F.col("c_name").alias("source"), F.explode(sets[F.col("c_mktsegment")]).alias("column"))


@query(
    "p03_detect_layout",
    """SELECT c_name AS source, CASE c_mktsegment WHEN 'FURNITURE' THEN 3 ELSE 4 END::BIGINT AS n_columns,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'long' WHEN 'BUILDING' THEN 'wide' WHEN 'FURNITURE' THEN 'unknown_header' WHEN 'HOUSEHOLD' THEN 'mixed_table_layout' ELSE 'ambiguous_header' END AS layout FROM customer""",
)
def detect_layout(spark, base):
    return mapping.detect_layout(mapping.file_headers(spark, _file_columns(spark, base)))


@query(
    "p04_wide_to_long",
    "WITH" + SUPPLIER_DAYS + """ SELECT unit_id, t, channel, value FROM (SELECT unit_id, t, unnest(['quantity', 'price', 'discount']) AS channel, unnest([quantity, price, CASE WHEN discount > 0 THEN discount END]) AS value FROM sd) WHERE value IS NOT NULL""",
)
def wide_to_long(spark, base):
    d = tb.supplier_days(spark, base).withColumn("discount", F.when(F.col("discount") > 0, F.col("discount")))
    return mapping.wide_to_long(d.select("unit_id", "t", "quantity", "price", "discount"), ["unit_id", "t"], ["quantity", "price", "discount"])


@query(
    "p05_long_to_steps",
    "WITH" + READINGS + """ SELECT unit_id, CAST(floor(t / 86400) AS BIGINT) AS t, max(value) FILTER (channel = 'click') AS click, max(value) FILTER (channel = 'view') AS view
FROM (SELECT unit_id, t, channel, arg_min(value, row_number) OVER (PARTITION BY unit_id, floor(t / 86400), channel) AS value FROM ev WHERE channel IN ('click', 'view')) GROUP BY 1, 2""",
)
def long_to_steps(spark, base):
    ev = tb.event_readings(spark, base).withColumn("t", F.floor(F.col("t") / 86400))
    one = ev.groupBy("unit_id", "t", "channel").agg(F.min_by("value", "row_number").alias("value"))
    return mapping.long_to_steps(one, ["click", "view"])


@query(
    "p06_parse_value",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 'NaN' WHEN p_size = 2 THEN '' WHEN p_size = 3 THEN 'abc' WHEN p_size = 4 THEN '[1]' WHEN p_size = 5 THEN 'Infinity' ELSE ' ' || p_retailprice || ' ' END AS cell, p_size, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice END AS value, CASE p_size WHEN 1 THEN 'nonfinite_value' WHEN 2 THEN 'empty_value' WHEN 3 THEN 'invalid_value' WHEN 4 THEN 'nested_table_cell' WHEN 5 THEN 'nonfinite_value' END AS issue FROM x""",
)
def parse_value(spark, base):
    p = tb.read(spark, base, "part")
    bad = {1: "NaN", 2: "", 3: "abc", 4: "[1]", 5: "Infinity"}
    cell = F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" "))
    for size, text in bad.items():
        cell = F.when(F.col("p_size") == size, F.lit(text)).otherwise(cell)
    return p.select("p_partkey", sc.parse_value(cell).alias("value"), sc.value_issue(cell).alias("issue"))


@query(
    "p07_parse_time",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'numeric' WHEN 'view' THEN 'iso_naive' WHEN 'error' THEN 'iso_aware' WHEN 'signup' THEN 'numeric' END AS kind,
 CASE event_type WHEN 'click' THEN event_id * 0.5e0 WHEN 'view' THEN epoch(date_trunc('second', ts)) WHEN 'error' THEN epoch(date_trunc('second', ts)) - 28800 WHEN 'signup' THEN 0e0 END AS seconds FROM events""",
)
def parse_time(spark, base):
    e = tb.read(spark, base, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("event_type") == "click", (F.col("event_id") * 0.5).cast("string"))
        .when(F.col("event_type") == "view", iso)
        .when(F.col("event_type") == "error", F.concat(iso, F.lit("+08:00")))
        .when(F.col("event_type") == "signup", "-0")
        .otherwise("yesterday")
    )
    return e.select("event_id", sc.time_kind(text).alias("kind"), sc.time_order(text).alias("seconds"))


@query(
    "p08_resolve_time_unit",
    """WITH x AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'cycle' WHEN 'AUTOMOBILE' THEN 'second' WHEN 'MACHINERY' THEN 'hour' END AS hint,
  CASE WHEN c_nationkey < 10 THEN 'auto' WHEN c_nationkey < 18 THEN 'second' WHEN c_nationkey < 22 THEN 'bin' ELSE 'week' END AS req FROM customer),
y AS (SELECT *, CASE WHEN req = 'auto' THEN hint ELSE req END AS chosen FROM x),
z AS (SELECT *, CASE WHEN req = 'week' THEN 'invalid_time_unit' WHEN req <> 'auto' AND hint IS NOT NULL AND req <> hint THEN 'time_unit_conflict' WHEN chosen IS NULL THEN 'time_unit_required' WHEN chosen NOT IN ('second', 'hour') THEN 'unsupported_time_unit' END AS code FROM y)
SELECT c_custkey, CASE WHEN code IS NULL THEN chosen END AS unit, code, CASE WHEN code IS NULL THEN CASE WHEN hint IS NOT NULL THEN 'header' ELSE 'user_selected' END END AS basis FROM z""",
)
def resolve_time_unit(spark, base):
    c = tb.read(spark, base, "customer")
    heads = joins.dimension(spark, [("BUILDING", "cycle"), ("AUTOMOBILE", "second"), ("MACHINERY", "hour")], "c_mktsegment string, hint string")
    n = F.col("c_nationkey")
    req = F.when(n < 10, "auto").when(n < 18, "second").when(n < 22, "bin").otherwise("week")
    out = c.join(heads, "c_mktsegment", "left").withColumn(
        "r", mapping.resolve_time_unit(req, F.col("hint"), F.array(F.lit("second"), F.lit("hour")))
    )
    return out.select("c_custkey", "r.unit", "r.code", "r.basis")


@query(
    "p08_batch_units",
    """SELECT c_custkey, 'hour' AS for_all, (['second', 'cycle', 'hour'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS by_position FROM customer""",
)
def batch_units(spark, base):
    position = (F.col("c_custkey") % 4).cast("int").alias("file_index")
    files_ = tb.read(spark, base, "customer").select("c_custkey", position)
    one = mapping.requested_units(files_, ["hour"]).withColumnRenamed("requested", "for_all")
    return mapping.requested_units(one, ["second", "cycle", "hour"]).select("c_custkey", "for_all", F.col("requested").alias("by_position"))


@query(
    "p08_time_headers",
    """SELECT c_name AS source, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'second' WHEN 'BUILDING' THEN 'cycle' WHEN 'MACHINERY' THEN 'hour' END AS time_hint FROM customer""",
)
def time_headers(spark, base):
    h = mapping.file_headers(spark, _file_columns(spark, base))
    return h.groupBy("source").agg(F.max("time_hint").alias("time_hint"))


@query(
    "p09_to_seconds",
    """SELECT event_id, value * CASE event_type WHEN 'click' THEN 1e-3 WHEN 'error' THEN 1e0 WHEN 'view' THEN 6e1 WHEN 'signup' THEN 36e2 WHEN 'purchase' THEN 864e2 END AS seconds FROM events""",
)
def to_seconds(spark, base):
    units = {"click": "millisecond", "error": "second", "view": "minute", "signup": "hour", "purchase": "day"}
    names = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    return tb.read(spark, base, "events").select("event_id", sc.to_seconds(F.col("value"), names[F.col("event_type")]).alias("seconds"))


@query("p10_bin_index", "WITH" + READINGS + " SELECT unit_id, row_number, CAST(floor(t / 574.0) AS BIGINT) AS bin FROM ev")
def bin_index(spark, base):
    return tb.event_readings(spark, base).select("unit_id", "row_number", sc.bin_index(F.col("t")).alias("bin"))


@query("p11_bin_age", "SELECT event_id, round((ceil((event_id + 1) * 57.4) - 1) * 10.0 / 86400.0, 9) AS age FROM events")
def bin_age(spark, base):
    return tb.read(spark, base, "events").select("event_id", F.round(sc.bin_age_days(F.col("event_id")), 9).alias("age"))


# -- identifiers -----------------------------------------------------------------
def _sample_id():
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    full = F.concat(
        F.when(k % 2 == 0, "RWA").otherwise("BAT"), F.lit("_LEO"), F.lit(500) + n, F.lit("_B"), F.lpad((n * 3).cast("string"), 2, "0"),
        F.lit("_H"), k % 3, F.lit("_L"), k % 5, F.lit("_S"), F.lpad(k.cast("string"), 3, "0"),
    )
    return (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("RWA_dev_S"), k))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("BAT copy ("), k, F.lit(")")))
        .otherwise(full)
    )


_SAMPLE_SQL = """s AS (SELECT c_custkey, c_mktsegment, c_nationkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'RWA_dev_S' || c_custkey WHEN 'FURNITURE' THEN 'BAT copy (' || c_custkey || ')'
 ELSE CASE WHEN c_custkey % 2 = 0 THEN 'RWA' ELSE 'BAT' END || '_LEO' || (500 + c_nationkey) || '_B' || lpad(CAST(c_nationkey * 3 AS VARCHAR), 2, '0') || '_H' || (c_custkey % 3) || '_L' || (c_custkey % 5) || '_S' || CASE WHEN c_custkey < 100 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE left(CAST(c_custkey AS VARCHAR), 3) END END AS sid FROM customer)"""


@query(
    "p12_parse_unit_id",
    "WITH " + _SAMPLE_SQL + """ SELECT c_custkey, left(sid, 3) AS part, CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') THEN 'LEO' || (500 + c_nationkey) END AS orbit,
 CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') THEN CAST(c_nationkey * 3 AS INTEGER) END AS beta_deg,
 CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') THEN CAST(c_custkey % 3 AS INTEGER) END AS h_level,
 CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') THEN CAST(c_custkey % 5 AS INTEGER) END AS load_level,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(c_custkey AS INTEGER) WHEN c_mktsegment <> 'FURNITURE' THEN CAST(right(sid, 3) AS INTEGER) END AS series,
 CASE c_mktsegment WHEN 'MACHINERY' THEN true WHEN 'FURNITURE' THEN NULL ELSE false END AS dev FROM s""",
)
def parse_unit_id(spark, base):
    c = tb.read(spark, base, "customer").select("c_custkey", sc.design_id(_sample_id()).alias("d"))
    return c.select("c_custkey", "d.*")


@query("s12_discover_inputs", "WITH " + _SAMPLE_SQL + " SELECT c_custkey, sid AS stem, c_mktsegment <> 'FURNITURE' AS accepted FROM s")
def discover_inputs(spark, base):
    c = tb.read(spark, base, "customer").select("c_custkey", F.concat(F.lit("raw/"), _sample_id(), F.lit(".mat")).alias("path"))
    return files.discover_inputs(c).select("c_custkey", "stem", "accepted")


@query(
    "p13_mask_ids",
    """SELECT c_custkey, CASE WHEN c_custkey >= 10 AND left(CAST(c_custkey AS VARCHAR), 2) IN ('21', '22') AND c_custkey >= 100 THEN 'BAT_N' ELSE 'BAT_S' END || c_custkey AS masked FROM customer""",
)
def mask_ids(spark, base):
    return tb.read(spark, base, "customer").select("c_custkey", sc.mask_ids(F.concat(F.lit("BAT_S"), "c_custkey")).alias("masked"))


@query(
    "p14_public_projection",
    """WITH d AS (SELECT doc_id, lang, n_chars / 20000 AS ratio, n_chars, text AS body FROM documents)
SELECT 'id.' || doc_id AS doc_id, doc_id AS ord, CASE WHEN trim(lang) <> '' AND NOT regexp_matches(lang, '^d') THEN lang END AS lang, CASE WHEN n_chars <= 8000 THEN CAST(n_chars AS DOUBLE) END AS size,
 CASE WHEN ratio <= 1 THEN ratio END AS ratio, CASE WHEN n_chars <= 8000 THEN n_chars END AS n, CASE WHEN trim(body) <> '' AND length(trim(body)) <= 2000 AND NOT regexp_matches(trim(body), '^d') THEN trim(body) END AS text FROM d""",
)
def public_projection(spark, base):
    d = tb.read(spark, base, "documents")
    size = F.when(F.col("n_chars") > 8000, float("inf")).otherwise(F.col("n_chars").cast("double"))
    rows = d.select(
        F.concat(F.lit("id."), "doc_id").alias("doc_id"), F.col("doc_id").alias("ord"), "lang", size.alias("size"),
        (F.col("n_chars") / 20000).alias("ratio"), size.alias("n"), "text",
    )
    again = rows.withColumn("ord", F.col("ord") + 1_000_000).withColumn("lang", F.lit("zz"))
    return evaluate.public_projection(rows.unionByName(again), "doc_id", {"lang": 40, "text": 2000}, ["size"], ["ratio"], ["n"], "^d", "ord")


@query(
    "p15_classify_metadata",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'target_or_future_information' WHEN 'BUILDING' THEN 'evaluation_context' WHEN 'FURNITURE' THEN 'target_or_future_information' ELSE 'provenance_context' END AS role FROM customer""",
)
def classify_metadata(spark, base):
    heads = {"AUTOMOBILE": ("rul", "Remaining_Life"), "BUILDING": ("degradation_state", "health"), "FURNITURE": ("note", "Y True"), "HOUSEHOLD": ("component", "part"), "MACHINERY": ("unit", "Units")}
    dim = joins.dimension(spark, [(k, *v) for k, v in heads.items()], "c_mktsegment string, canonical string, header string")
    c = tb.read(spark, base, "customer").join(dim, "c_mktsegment")
    return c.select("c_custkey", sc.metadata_role(F.col("canonical"), F.col("header")).alias("role"))


@query(
    "p17_health_index",
    "WITH" + STEPS + """ SELECT unit_id, step, round(greatest(0.0, (1 - k / 100) / 0.2), 6) AS battery,
 round(greatest(value / 2.0, (hour / 1000 - first_value(hour / 1000) OVER w) / (0.045 - first_value(hour / 1000) OVER w)), 6) AS wheel FROM st WINDOW w AS (PARTITION BY unit_id ORDER BY step)""",
)
def health_index(spark, base):
    axis = tb.event_axis(spark, base)
    st = tb.event_steps(spark, base, axis)
    first = F.max(F.when(F.col("step") == 0, F.col("hour")))
    out = sg.unit_values(st, axis, {"h0": (first, F.max)})
    return out.select(
        "unit_id", "step", F.round(sc.battery_health(F.col("k") / 100), 6).alias("battery"),
        F.round(sc.wheel_health(F.col("value"), F.col("hour") / 1000, F.col("h0") / 1000), 6).alias("wheel"),
    )


@query(
    "p18_age_features",
    "WITH" + READINGS + " SELECT row_number, round(t / 864000, 9) AS r, round((t / 864000) * (t / 864000), 9) AS r2, round(sqrt(greatest(t / 864000, 0)), 9) AS rs FROM ev",
)
def age_features(spark, base):
    a = tb.event_readings(spark, base).select("row_number", sc.age_features(F.col("t"), 864000.0).alias("a"))
    get = lambda i: F.round(F.get("a", F.lit(i)), 9)
    return a.select("row_number", get(0).alias("r"), get(1).alias("r2"), get(2).alias("rs"))


@query("p19_cap_label", "SELECT event_id, round(value / 150, 9) AS y, greatest(0.0, least(1.0, value / 150)) * 150 AS capped FROM events")
def cap_label(spark, base):
    y = F.col("value") / 150.0
    return tb.read(spark, base, "events").select("event_id", F.round(y, 9).alias("y"), (sc.clip_unit(y) * 150.0).alias("capped"))


@query("p20_round4", "SELECT event_id, round_even(value / 3, 4) AS shown FROM events")
def round4(spark, base):
    return tb.read(spark, base, "events").select("event_id", sc.round_half_even(F.col("value") / 3).alias("shown"))


# -- orbits ------------------------------------------------------------------------
_ORBIT = f"""o AS (SELECT c_custkey, {fv.EARTH_RADIUS_KM} + 50 + c_custkey AS a, abs(c_acctbal) / 8000 AS e FROM customer),
q AS (SELECT *, -{fv.EARTH_MU_KM3_S2} / (2 * a) AS energy, CASE WHEN e < 1 THEN a * (1 - e) - {fv.EARTH_RADIUS_KM} WHEN e > 1 THEN abs(a) * (e - 1) - {fv.EARTH_RADIUS_KM} END AS per,
             CASE WHEN e < 1 THEN a * (1 + e) - {fv.EARTH_RADIUS_KM} END AS apo FROM o)"""


@query(
    "p21_orbit_facts",
    "WITH " + _ORBIT + f""" SELECT c_custkey, round(per, 6) AS perigee_km, round(apo, 6) AS apogee_km, round(CASE WHEN e < 1 THEN 2 * pi() * sqrt(a * a * a / {fv.EARTH_MU_KM3_S2}) / 60 END, 6) AS period_min,
 round(CASE WHEN e < 1 THEN sqrt(greatest(0, {fv.EARTH_MU_KM3_S2} * (2 / (apo + {fv.EARTH_RADIUS_KM}) - 1 / a))) END, 6) AS speed_min_km_s,
 round(CASE WHEN e < 1 AND per + {fv.EARTH_RADIUS_KM} > 0 THEN sqrt(greatest(0, {fv.EARTH_MU_KM3_S2} * (2 / (per + {fv.EARTH_RADIUS_KM}) - 1 / a))) END, 6) AS speed_max_km_s,
 CASE WHEN e >= 1 THEN 'inconsistent' WHEN e < 0.01 THEN 'circular' WHEN per >= {fv.MIN_PERIGEE_KM} THEN 'ellipse' ELSE 'suborbital' END AS orbit_class, e < 1 AND per >= {fv.MIN_PERIGEE_KM} AS drawable FROM q""",
)
def orbit_facts(spark, base):
    c = tb.read(spark, base, "customer").select(
        "c_custkey", (F.lit(fv.EARTH_RADIUS_KM) + 50 + F.col("c_custkey")).alias("a"), (F.abs("c_acctbal") / 8000).alias("e")
    )
    facts = sc.orbit_facts(F.col("a"), F.col("e"))
    out = c.select("c_custkey", *[v.alias(k) for k, v in facts.items()])
    return rounded(out, ["perigee_km", "apogee_km", "period_min", "speed_min_km_s", "speed_max_km_s"])


@query(
    "p21_parabola",
    f"""WITH p AS (SELECT c_custkey, {fv.EARTH_RADIUS_KM} + c_acctbal / 10 AS q FROM customer)
SELECT c_custkey, round(q - {fv.EARTH_RADIUS_KM}, 6) AS perigee_km, 'parabola' AS orbit_class, q - {fv.EARTH_RADIUS_KM} >= {fv.MIN_PERIGEE_KM} AS drawable FROM p""",
)
def parabola(spark, base):
    parameter = 2 * (F.lit(fv.EARTH_RADIUS_KM) + F.col("c_acctbal") / 10)
    facts = sc.orbit_facts(F.lit(None).cast("double"), F.lit(1.0), parameter=parameter)
    out = tb.read(spark, base, "customer").select("c_custkey", *[facts[c].alias(c) for c in ("perigee_km", "orbit_class", "drawable")])
    return rounded(out, ["perigee_km"])


@query(
    "p21_elements_valid",
    f"""SELECT c_custkey, c_acctbal > 0 AND c_nationkey * 8 <= 180 AS valid, round({fv.EARTH_RADIUS_KM} + c_acctbal, 6) AS a, 0e0 AS e FROM customer""",
)
def elements_valid(spark, base):
    a, e = sc.orbit_from_circular(F.col("c_acctbal"))
    valid = sc.elements_valid(a, e, F.col("c_nationkey") * 8.0)
    return tb.read(spark, base, "customer").select("c_custkey", valid.alias("valid"), F.round(a, 6).alias("a"), e.alias("e"))


@query(
    "p22_orbit_from_apsides",
    f"""SELECT c_custkey, round((2 * {fv.EARTH_RADIUS_KM} + 200 + c_custkey + 400 + 2 * c_custkey) / 2, 6) AS a, round((200 + c_custkey) / (2 * {fv.EARTH_RADIUS_KM} + 600 + 3 * c_custkey), 9) AS e FROM customer""",
)
def orbit_from_apsides(spark, base):
    k = F.col("c_custkey")
    a, e = sc.orbit_from_apsides(200 + k, 400 + 2 * k)
    return tb.read(spark, base, "customer").select("c_custkey", F.round(a, 6).alias("a"), F.round(e, 9).alias("e"))


@query(
    "p22_orbit_from_state",
    f"""WITH s AS (SELECT c_custkey, {fv.EARTH_RADIUS_KM} + 300 + c_custkey AS r, 6 + c_nationkey / 4e0 AS v FROM customer), g AS (SELECT *, v * v / 2 - {fv.EARTH_MU_KM3_S2} / r AS energy FROM s)
SELECT c_custkey, round(energy, 6) AS energy, round(-{fv.EARTH_MU_KM3_S2} / (2 * energy), 3) AS a, round(abs(r * v * v / {fv.EARTH_MU_KM3_S2} - 1), 9) AS e,
 CASE WHEN abs(r * v * v / {fv.EARTH_MU_KM3_S2} - 1) >= 1 OR energy >= 0 THEN 'open' ELSE 'closed' END AS kind FROM g""",
)
def orbit_from_state(spark, base):
    a, e, energy = sc.orbit_from_state(300 + F.col("c_custkey"), 6 + F.col("c_nationkey") / 4)
    kind = sc.orbit_facts(a, e, energy)["orbit_class"]
    return tb.read(spark, base, "customer").select(
        "c_custkey", F.round(energy, 6).alias("energy"), F.round(a, 3).alias("a"), F.round(e, 9).alias("e"),
        F.when(kind.isin("hyperbola", "parabola"), "open").otherwise("closed").alias("kind"),
    )


# -- lookups and small texts ---------------------------------------------------------
@query(
    "p23_lookup_code",
    """SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'none' WHEN 1 THEN 'rw_wear_over_threshold' WHEN 2 THEN 'rw_speed_tracking_fail' WHEN 3 THEN 'rw_lube_sudden_loss' WHEN 11 THEN 'bat_soh_le_80' WHEN 12 THEN 'bat_micro_short' ELSE CAST(c_nationkey AS VARCHAR) END AS mode FROM customer""",
)
def lookup_code(spark, base):
    table = joins.dimension(spark, list(fv.FAILURE_CODES.items()), "code int, mode string")
    c = tb.read(spark, base, "customer")
    return joins.lookup(c, "c_nationkey", table, "code", "mode", F.col("c_nationkey").cast("string")).select("c_custkey", "mode")


@query(
    "p24_parse_flat_config",
    """SELECT p_partkey, 'brand' AS key, p_brand AS value, false AS is_override, CAST(NULL AS DOUBLE) AS number FROM part
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), false, p_size FROM part UNION ALL SELECT p_partkey, 'load.price', CAST(p_retailprice AS VARCHAR), true, p_retailprice FROM part
UNION ALL SELECT p_partkey, 'load.name', p_name, true, NULL FROM part UNION ALL SELECT p_partkey, 'kind', p_type, false, NULL FROM part""",
)
def flat_config(spark, base):
    p = tb.read(spark, base, "part")
    text = F.concat(
        F.lit("# card\nbrand: "), "p_brand", F.lit("\nsize:  "), F.col("p_size").cast("string"), F.lit("\n\noverrides:\n  load.price: "),
        F.col("p_retailprice").cast("string"), F.lit("\n  load.name: "), "p_name", F.lit("\nkind: "), "p_type", F.lit("\n  stray: 1"),
    )
    rows = p.select("p_partkey", F.explode(sc.config_lines(text)).alias("c"))
    return rows.select(
        "p_partkey", "c.key", "c.value", F.col("c.override").alias("is_override"), F.col("c.value").try_cast("double").alias("number")
    )


@query("p25_parse_note_pairs", "SELECT p_partkey, p_brand AS loss_model, p_type AS lubricant FROM part")
def note_pairs(spark, base):
    p = tb.read(spark, base, "part")
    note = F.concat(F.lit("loss_model=old; other=1 ; loss_model = "), F.lit('"'), "p_brand", F.lit('";free text; lubricant='), "p_type")
    m = p.select("p_partkey", sc.note_pairs(note, ["loss_model", "lubricant"]).alias("m"))
    return m.select("p_partkey", F.try_element_at("m", F.lit("loss_model")).alias("loss_model"), F.try_element_at("m", F.lit("lubricant")).alias("lubricant"))


@query("p26_json_scalar", """SELECT event_id, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k FROM events""")
def json_scalar(spark, base):
    e = tb.read(spark, base, "events")
    return e.select("event_id", F.from_json("props", "struct<k: bigint>")["k"].alias("k"))


@query(
    "p27_rename_public_keys",
    """SELECT s_suppkey, CAST(NULL AS INTEGER) AS selected_member, '{"model_version_hash":"' || replace(s_name, 'Supplier', 'Source') || '","members":[{"member_count":' || (s_suppkey % 4) ||
 ',"note":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'three_model' ELSE 'requirements Source' END || '"},{"member_count":0,"note":"requirements"}],"by_name":{"input_requirements":"Source ' || s_nationkey || '"}}' AS record FROM supplier""",
)
def rename_public(spark, base):
    """A nested record: keys renamed at every depth, lists shown as counts, words replaced in all texts."""
    s = tb.read(spark, base, "supplier")
    seeds = F.slice(F.array(F.lit(17), F.lit(42), F.lit(73)), 1, (F.col("s_suppkey") % 4).cast("int"))
    note = F.when(F.col("s_suppkey") % 2 == 0, "three_seed").otherwise("contract Supplier")
    first = F.struct(seeds.alias("interval_member_seeds"), note.alias("note"))
    second = F.struct(F.array().cast("array<int>").alias("interval_member_seeds"), F.lit("contract").alias("note"))
    by_name = F.create_map(F.lit("input_contract"), F.concat(F.lit("Supplier "), F.col("s_nationkey").cast("string")))
    record = F.struct(F.col("s_name").alias("manifest_sha256"), F.array(first, second).alias("members"), by_name.alias("by_name"))
    rows = s.select("s_suppkey", F.col("s_suppkey").alias("production_point_seed"), record.alias("record"))
    words = {"three_seed": "three_model", "contract": "requirements", "Supplier": "Source"}
    out = evaluate.rename_public(rows, fv.PUBLIC_NAMES, words, ("interval_member_seeds", "production_point_seed"))
    return out.withColumn("record", F.to_json("record"))


@query(
    "p28_text_search",
    "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)) || ' ' || regexp_replace(lower(p_name), '[\\s_.-]+', '', 'g') || ' ' || regexp_replace(lower(p_brand), '[\\s_.#-]+', '', 'g'), 'red') AND contains(lower(p_brand), 'brand#1')",
)
def text_search(spark, base):
    # names in full-width letters are found by their compatibility form
    p = tb.read(spark, base, "part").withColumn("p_name", F.translate("p_name", "red", "ＲＥＤ"))
    return mapping.text_search(p, ["p_name", "p_brand"], "Brand#1, RED").select("p_partkey")


@query(
    "a11_metadata_summary",
    """WITH c AS (SELECT user_id, unnest(['event_type', 'props']) AS field, unnest([event_type, CASE WHEN value > 50 THEN props END]) AS text FROM events),
v AS (SELECT user_id, field, text, count(*) AS n FROM c WHERE text IS NOT NULL GROUP BY 1, 2, 3)
SELECT user_id, field, CAST(sum(n) AS BIGINT) AS nonempty_count, count(*) AS n_distinct, count(*) > 8 AS truncated, count(*) = 1 AS is_static FROM v GROUP BY 1, 2""",
)
def metadata_summary(spark, base):
    e = tb.read(spark, base, "events").withColumn("props", F.when(F.col("value") > 50, F.col("props")))
    return mapping.metadata_summary(e.select("user_id", "event_type", "props"), ["user_id"], ["event_type", "props"])


@query(
    "a11_first_values",
    "SELECT user_id, text, rank FROM (SELECT user_id, props AS text, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS rank FROM (SELECT user_id, props, min(event_id) AS first FROM events GROUP BY 1, 2)) WHERE rank < 8",
)
def first_values(spark, base):
    return mapping.first_values(tb.read(spark, base, "events"), ["user_id"], "props", order=["event_id"])


@query(
    "a11_values_by_channel",
    """WITH f AS (SELECT user_id, event_type, props, min(event_id) AS first FROM events GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY first) AS rank FROM f)
SELECT user_id, event_type, string_agg(props, '|' ORDER BY rank) AS texts, count(*) > 1 AS inconsistent FROM r WHERE rank <= 8 GROUP BY 1, 2""",
)
def values_by_channel(spark, base):
    found = mapping.values_by_channel(tb.read(spark, base, "events"), ["user_id"], "event_type", "props", ["event_id"])
    return found.withColumn("texts", F.array_join("texts", "|"))


@query(
    "a25_dataset_tiers",
    """WITH m AS (SELECT lang AS tier, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM documents GROUP BY 1)
SELECT tier, file_count + CASE WHEN tier = 'de' THEN 1 ELSE 0 END AS declared_files, total_bytes AS declared_bytes, file_count, total_bytes, tier <> 'de' AS matches FROM m""",
)
def dataset_tiers(spark, base):
    d = tb.read(spark, base, "documents").select(F.col("lang").alias("tier"), F.col("n_chars").alias("bytes"))
    declared = d.groupBy("tier").agg(
        (F.count(F.lit(1)) + F.when(F.col("tier") == "de", 1).otherwise(0)).alias("declared_files"), F.sum("bytes").alias("declared_bytes")
    )
    return evaluate.dataset_tiers(d, declared)


_A26_CHANNELS = ("t", "orbit.beta_deg", "rw.speed_rpm", "rw.friction_torque_nm", "label.rul")


@query(
    "a26_dataset_metadata",
    """SELECT c_mktsegment AS dataset_id, '{"schema_version":"1","dataset_id":"' || c_mktsegment || '","display_name":"' || lower(c_mktsegment) || '","domain":"","role":"","product_line":"","profile":"timeseries","t_unit":"day","license_cite":"","source_url":"",'
 || '"parser":{"module":"tables","version":"' || count(*) || '"},"created_utc":"","native_checksums_ref":"","notes":"","channels":['
 || '{"name":"t","unit":"day","visibility":"index","dtype":"float64","desc":"time"},{"name":"orbit.beta_deg","unit":"deg","visibility":"env","dtype":"float32","desc":""},{"name":"rw.speed_rpm","unit":"rpm","visibility":"telemetry","dtype":"float32","desc":""},'
 || '{"name":"rw.friction_torque_nm","unit":"N·m","visibility":"privileged","dtype":"float32","desc":""},{"name":"label.rul","unit":"day","visibility":"label","dtype":"float32","desc":""}]}' AS document FROM customer GROUP BY c_mktsegment""",
)
def dataset_metadata(spark, base):
    c = tb.read(spark, base, "customer").groupBy(F.col("c_mktsegment").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"))
    parser = F.struct(F.lit("tables").alias("module"), F.col("n").cast("string").alias("version"))
    known = c.select(
        "dataset_id", F.lower("dataset_id").alias("display_name"), F.lit("1").alias("schema_version"), F.lit("timeseries").alias("profile"),
        F.lit("day").alias("t_unit"), parser.alias("parser"), F.lit(None).cast("string").alias("notes"),
    )
    return evaluate.dataset_documents(known, list(_A26_CHANNELS), {"t": "time"})


@query(
    "a26_unit_documents",
    """SELECT c_mktsegment AS dataset_id, CAST(c_custkey AS VARCHAR) AS unit_id, '{"c_nationkey":' || c_nationkey || ',"c_name":"' || c_name || '"}' AS document FROM customer""",
)
def unit_documents(spark, base):
    """Every unit of every document, taken out of it again; parts are bounded and sorted by id."""
    reg = tb.read(spark, base, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_mktsegment").alias("dataset_id"), "c_nationkey", "c_name")
    parts = evaluate.unit_documents(reg, ("dataset_id",), 100)
    units = F.from_json("document", "map<string, struct<c_nationkey: int, c_name: string>>")
    each = parts.select("dataset_id", F.explode(units).alias("unit_id", "unit"))
    return each.select("dataset_id", "unit_id", F.to_json("unit").alias("document"))


# -- sources and sinks ----------------------------------------------------------------
@query("s03_read_columnar", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, 'events.parquet' AS file FROM events GROUP BY 1")
def read_columnar(spark, base):
    df = files.read_columnar(spark, f"{base}/events.parquet")
    name = F.element_at(F.split("source", "/"), -1)
    return df.groupBy("event_type", name.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s06_write_unit_dataset", "WITH" + SUPPLIER_DAYS + " SELECT unit_id, t, quantity, price FROM sd")
def write_unit_dataset(spark, base):
    path = f"{storage.checkpoint_folder(spark)}/units-{uuid.uuid4().hex}"
    d = tb.supplier_days(spark, base).select("unit_id", "t", "quantity", "price")
    files.write_unit_dataset(d, path, tb.DAY_AXIS)
    back = files.read_unit_dataset(spark, path)
    return back.select(F.col("unit_id").cast("bigint").alias("unit_id"), "t", "quantity", "price")


@query("s06_read_units", "WITH" + SUPPLIER_DAYS + " SELECT unit_id, t, quantity FROM sd WHERE unit_id IN (1, 7)")
def read_units(spark, base):
    """Two units of a stored dataset that has been written twice: only their buckets are read."""
    path = f"{storage.checkpoint_folder(spark)}/units-{uuid.uuid4().hex}"
    d = tb.supplier_days(spark, base).select("unit_id", "t", "quantity")
    files.write_unit_dataset(d.where("unit_id < 5"), path, tb.DAY_AXIS)
    files.write_unit_dataset(d, path, tb.DAY_AXIS)
    return files.read_unit_dataset(spark, path, [(1,), (7,)])


@query("s07_write_predictions", "SELECT CAST(event_id AS VARCHAR) AS window_id, CAST(user_id AS VARCHAR) AS unit_id, value AS prediction, 'days' AS rul_unit FROM events")
def write_predictions(spark, base):
    path = f"{storage.checkpoint_folder(spark)}/predictions-{uuid.uuid4().hex}"
    e = tb.read(spark, base, "events").select(
        F.col("event_id").alias("window_id"), F.col("user_id").alias("unit_id"), F.col("event_id").alias("t_end"), F.lit("wheel").alias("route_id"),
        F.col("value").alias("prediction"), F.lit("days").alias("rul_unit"), F.col("value").alias("truth"),
    )
    files.write_predictions(e, path)
    back = spark.read.option("header", True).csv(path)
    return back.select("window_id", "unit_id", F.col("prediction").cast("double").alias("prediction"), "rul_unit")


@query(
    "s08_export_batch",
    """SELECT CAST(c_name AS VARCHAR) AS filename, sha256(c_name) AS input_sha256, CASE WHEN c_custkey % 2 = 0 THEN 'box.zip' ELSE '' END AS container_filename, '' AS container_sha256,
 CASE WHEN c_custkey % 2 = 0 THEN c_name || '.csv' ELSE '' END AS archive_member, 'battery' AS line, 'ensemble' AS model_name, 'spark' AS framework, sha256(c_mktsegment) AS manifest_sha256,
 'a;' || c_nationkey AS member_sha256s, 'median3' AS selection_aggregation, 'median3' AS production_point_aggregation, '' AS production_point_seed, '17;42;73' AS interval_member_seeds,
 'members' AS uncertainty_mode, CAST(o_orderkey AS BIGINT) AS window_index, strftime(o_orderdate, '%Y-%m-%d') AS time, CAST(o_orderkey AS DOUBLE) AS time_order, 'cycles' AS rul_unit,
 o_totalprice AS y_pred_rul_raw, greatest(0, o_totalprice - 1000) AS y_pred_rul, o_totalprice < 1000 AS rul_output_clamped, o_totalprice - 1 AS p10, o_totalprice AS p50, o_totalprice + 1 AS p90,
 o_totalprice / 4 AS ensemble_std FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def export_batch(spark, base):
    o = tb.read(spark, base, "orders")
    c = tb.read(spark, base, "customer")
    price = F.col("o_totalprice")
    preds = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_name").alias("filename"), F.col("o_orderkey").cast("bigint").alias("window_index"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"),
        F.col("o_orderkey").cast("double").alias("time_order"), price.alias("y_pred_rul_raw"), F.greatest(F.lit(0.0), price - 1000).alias("y_pred_rul"),
        (price < 1000).alias("rul_output_clamped"), (price - 1).alias("p10"), price.alias("p50"), (price + 1).alias("p90"), (price / 4).alias("ensemble_std"),
    )
    packed_in = F.col("c_custkey") % 2 == 0
    registry = c.select(
        F.col("c_name").alias("filename"), F.sha2("c_name", 256).alias("input_sha256"),
        F.when(packed_in, "box.zip").alias("container_filename"), F.lit(None).cast("string").alias("container_sha256"),
        F.when(packed_in, F.concat("c_name", F.lit(".csv"))).alias("archive_member"), F.lit(None).cast("int").alias("production_point_seed"),
        F.lit("battery").alias("line"), F.lit("ensemble").alias("model_name"), F.lit("spark").alias("framework"), F.sha2("c_mktsegment", 256).alias("manifest_sha256"),
        F.array(F.lit("a"), F.col("c_nationkey").cast("string")).alias("member_sha256s"), F.lit("median3").alias("selection_aggregation"),
        F.lit("median3").alias("production_point_aggregation"), F.array(F.lit(17), F.lit(42), F.lit(73)).alias("interval_member_seeds"),
        F.lit("members").alias("uncertainty_mode"), F.lit("cycles").alias("rul_unit"),
    )
    return files.export_batch(preds, registry)


def _event_predictions(spark, base):
    """Predictions of events with cells that are no prediction: no unit, another route, no number."""
    e = tb.read(spark, base, "events")
    v = F.col("value")
    return e.select(
        F.col("event_id").cast("string").alias("window_id"), F.when(F.col("event_type") == "signup", " ").otherwise(F.col("user_id").cast("string")).alias("unit_id"),
        F.col("event_id").cast("string").alias("t_end"), F.when(F.col("event_type") == "view", "other").otherwise("wheel").alias("route_id"),
        F.when(v > 300, "nan").when(v < 1, "bad").otherwise(v.cast("string")).alias("prediction"), F.lit("days").alias("rul_unit"), F.lit("1").alias("truth"),
    )


@query(
    "s10_read_predictions",
    """SELECT count(*) FILTER (event_type NOT IN ('signup', 'view') AND value BETWEEN 1 AND 300) AS n_windows,
 count(*) FILTER (event_type IN ('signup', 'view') OR value > 300 OR value < 1) AS invalid_rows, count(DISTINCT CASE WHEN event_type NOT IN ('signup', 'view') AND value BETWEEN 1 AND 300 THEN user_id END) AS n_units FROM events""",
)
def read_predictions(spark, base):
    """Written as CSV with its columns in another order and one more, read by header."""
    path = _folder(spark, "prediction-csv")
    rows = _event_predictions(spark, base)
    rows.select("truth", F.lit("x").alias("more"), *[c for c in rows.columns if c != "truth"]).write.option("header", True).csv(path)
    return delimited.prediction_counts(delimited.read_prediction_csv(spark, path, "wheel"))


@query(
    "s09_append_run_ledger",
    """WITH p AS (SELECT o_custkey % 10 AS t, o_totalprice AS y, o_totalprice + o_orderkey % 7 AS p FROM orders)
SELECT 'run-a' AS run_id, 'prediction' AS stage, 'pass' AS status, 'battery' AS component, 'validation' AS split, 'R1' AS route_id, 'cycles' AS rul_unit, count(*) AS n_windows,
 count(*) AS n_in_files, count(*) AS n_read, count(*) AS n_input, 1 AS n_receipts, TRUE AS digests, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(avg(p - y), 6) AS bias FROM p""",
)
def run_ledger(spark, base):
    """A run written twice under one id: one receipt, files with their digests, and the predictions it names."""
    path = _folder(spark, "runs")
    o = tb.read(spark, base, "orders")
    predictions = o.select(
        F.col("o_orderkey").alias("window_id"), F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").cast("double").alias("t_end"), F.lit("R1").alias("route_id"),
        (F.col("o_totalprice") + F.col("o_orderkey") % 7).alias("prediction"), F.lit("cycles").alias("rul_unit"), F.col("o_totalprice").alias("truth"),
    )
    for _ in range(2):
        runs.write_run(spark, path, "run-a", predictions, "battery", "validation", "R1", "cycles", {"orders": o})
    back = runs.read_run(spark, path, "run-a", "R1").where("valid").agg(F.count(F.lit(1))).scalar()
    stored = spark.read.format("binaryFile").load(f"{path}/runs/run-a/*.csv")
    found = stored.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    whole = lambda rows: rows.agg(F.sort_array(F.collect_list(F.concat_ws(":", "name", F.col("bytes").cast("string"), "sha256")))).scalar()
    receipts = runs.read_ledger(spark, path)
    named = receipts.select(F.explode("files").alias("f")).select("f.*")
    metric = lambda k: F.round(F.col("metrics")[k], 6).alias(k)
    return receipts.select(
        "run_id", "stage", "status", "component", "split", "route_id", "rul_unit", "n_windows",
        F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + f["n_rows"]).alias("n_in_files"), back.alias("n_read"),
        F.col("inputs")[0]["n_rows"].alias("n_input"), receipts.agg(F.count(F.lit(1)).cast("int")).scalar().alias("n_receipts"),
        (whole(found) == whole(named)).alias("digests"), metric("rmse"), metric("mae"), metric("bias"),
    )


def _folder(spark, kind):
    return f"{storage.checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query(
    "s01_read_delimited",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name, c_acctbal FROM customer)
SELECT CAST(k AS VARCHAR) AS key, CASE WHEN n % 5 = 3 THEN '名' || c_name ELSE c_name END AS name, CASE WHEN n % 5 < 4 THEN CAST(c_acctbal AS VARCHAR) END AS balance, NULL AS code FROM c
UNION ALL SELECT NULL, '1;2;3;4', NULL, 'row_column_count' FROM c WHERE n % 5 = 1 GROUP BY n""",
)
def read_delimited(spark, base):
    """A file a nation: comma, semicolon, tab, GB18030, and one of another width; some with a bad line."""
    path, folder = _folder(spark, "delimited"), _folder(spark, "delimited-utf8")
    c = tb.read(spark, base, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("string").alias("balance"), F.col("c_nationkey").alias("nation"))
    fixtures.write_each(c, "nation", path, fixtures.delimited_file).collect()
    cells, issues = delimited.read_delimited_files(spark, path, folder)
    cell = lambda name: F.max(F.when(F.col("column") == name, F.col("text"))).alias(name)
    wide = cells.groupBy("source", "record_id").agg(cell("key"), cell("name"), cell("balance"))
    read = wide.select("key", "name", "balance", F.lit(None).cast("string").alias("code"))
    bad = issues.select(F.lit(None).cast("string").alias("key"), F.col("line").alias("name"), F.lit(None).cast("string").alias("balance"), "code")
    return read.unionByName(bad)


@query(
    "s02_read_json_records",
    """SELECT 'event_id' AS "column", count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total FROM events UNION ALL SELECT 'user_id', count(*), CAST(sum(user_id) AS DOUBLE) FROM events""",
)
def read_json_records(spark, base):
    path = _folder(spark, "records")
    e = tb.read(spark, base, "events")
    e.select(F.to_json(F.struct("event_id", "user_id")).alias("value")).write.text(path)
    cells, issues = records.read_json_records(spark, path)
    read = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").cast("bigint")).cast("double").alias("total"))
    return read.unionByName(issues.groupBy(F.col("code").alias("column")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total")))


def _packed_totals(cells, issues):
    """Rows and sum of each column, and the number of files and members of each code."""
    read = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").try_cast("double")).cast("bigint").alias("total"))
    return read.unionByName(issues.groupBy(F.col("code").alias("column")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("total")))


@query(
    "s02_json_arrays",
    """SELECT 'key' AS "column", count(*) AS n, CAST(sum(c_custkey) AS DOUBLE) AS total FROM customer WHERE c_nationkey % 4 < 3 UNION ALL
SELECT 'name', count(*), NULL FROM customer WHERE c_nationkey % 4 < 3 UNION ALL SELECT 'json_record_shape', count(DISTINCT c_nationkey), NULL FROM customer WHERE c_nationkey % 4 = 3 HAVING count(*) > 0""",
)
def read_json_arrays(spark, base):
    """A JSON array a nation: of objects, of rows below a header, and of records of two shapes."""
    path = _folder(spark, "json-arrays")
    c = tb.read(spark, base, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    fixtures.write_each(c, "nation", path, fixtures.json_file).collect()
    cells, issues = records.read_json_records(spark, path, lines=False)
    read = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").try_cast("double")).alias("total"))
    return read.unionByName(issues.groupBy(F.col("code").alias("column")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total")))


@query(
    "s04_ingest_many_files",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT 'key' AS "column", count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM c WHERE n % 8 < 6 UNION ALL SELECT 'nation', count(*), CAST(sum(n) AS BIGINT) FROM c WHERE n % 8 < 6
UNION ALL SELECT 'note', count(*), NULL FROM c WHERE n % 8 = 1 HAVING count(*) > 0
UNION ALL SELECT CASE n % 8 WHEN 6 THEN 'binary_column_length' ELSE 'row_column_count' END, count(DISTINCT n), NULL FROM c WHERE n % 8 >= 6 GROUP BY 1""",
)
def ingest_many_files(spark, base):
    """A file a nation: delimited (UTF-8 and GB18030), Feather, Arrow stream, NPY, NPZ, and files with faults."""
    path, folder = _folder(spark, "many"), _folder(spark, "many-read")
    c = tb.read(spark, base, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    fixtures.write_each(c, "nation", path, fixtures.table_file).collect()
    return _packed_totals(*packed.read_packed(spark, path, folder, packed.Limits(rows=1000)))


@query(
    "s05_expand_archives",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), g AS (SELECT * FROM c WHERE n % 5 < 3)
SELECT 'key' AS "column", count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM g UNION ALL SELECT 'nation', count(*), CAST(sum(n) AS BIGINT) FROM g
UNION ALL SELECT CASE n % 5 WHEN 3 THEN 'unsafe_zip_member' ELSE 'duplicate_tar_member' END, count(DISTINCT n), NULL FROM c WHERE n % 5 >= 3 GROUP BY 1
UNION ALL SELECT 'row_column_count', count(DISTINCT n), NULL FROM c WHERE n % 5 = 0 HAVING count(*) > 0""",
)
def expand_archives(spark, base):
    """An archive a nation: zip and tar.xz with tables of several kinds, single gzip files, and archives with faults."""
    path, folder = _folder(spark, "archives"), _folder(spark, "archives-read")
    c = tb.read(spark, base, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    fixtures.write_each(c, "nation", path, fixtures.archive_file).collect()
    return _packed_totals(*packed.read_packed(spark, path, folder))


@query("s11_read_commented_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def read_commented_csv(spark, base):
    """A file a nation, with comments before the header and between the rows."""
    path = _folder(spark, "commented")
    s = tb.read(spark, base, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    fixtures.write_each(s, "nation", path, fixtures.commented_file).collect()
    return delimited.read_commented_csv(spark, path)
