"""Queries for the validation rules and integrity checks.

Faults are written into columns derived from the tables, so each rule finds some.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.functions import scalar as sc
from lifespan.operators import joins, ledger, rules
from lifespan.operators.segments import Axis
from lifespan.plans.registry import READINGS, STEPS, SUPPLIER_DAYS, query
from lifespan.sources import fixtures, storage
from lifespan.sources import tables as tb

CHANNEL_OF = {
    "click": "bat.capacity_ah", "error": "rw.speed_rpm", "purchase": "bat.temp_mean_c",
    "signup": "bat.charge_time_s", "view": "rw.motor_current_a",
}
UNITS_SQL = """
du AS (SELECT unit_id, row_number, CASE channel WHEN 'click' THEN 'bat.capacity_ah' WHEN 'error' THEN 'rw.speed_rpm'
         WHEN 'purchase' THEN 'bat.temp_mean_c' WHEN 'signup' THEN 'bat.charge_time_s' ELSE 'rw.motor_current_a' END AS channel,
         CASE WHEN unit_id % 10 = 3 AND value > 100 THEN 'mAh' ELSE CASE channel WHEN 'click' THEN 'Ampere-Hour' WHEN 'error' THEN 'REV/min'
         WHEN 'purchase' THEN 'degC' WHEN 'signup' THEN 'sec' ELSE ' A ' END END AS declared_unit FROM ev)"""


def declared_units(spark, base):
    ev = tb.event_readings(spark, base)
    names = F.create_map(*[F.lit(x) for kv in CHANNEL_OF.items() for x in kv])
    spelled = F.create_map(*[F.lit(x) for kv in {
        "click": "Ampere-Hour", "error": "REV/min", "purchase": "degC", "signup": "sec", "view": " A ",
    }.items() for x in kv])
    return ev.select(
        "unit_id",
        names[F.col("channel")].alias("channel"),
        F.when((F.col("unit_id") % 10 == 3) & (F.col("value") > 100), "mAh")
        .otherwise(spelled[F.col("channel")]).alias("declared_unit"),
    )


@query(
    "v01_duplicate_observation",
    """SELECT l_suppkey AS unit_id, 'duplicate_observation' AS code,
       concat_ws('|', CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_returnflag, count(*)) AS details
       FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), l_returnflag HAVING count(*) > 1""",
)
def duplicates(spark, base):
    li = tb.read(spark, base, "lineitem").select(
        F.col("l_suppkey").alias("unit_id"), F.to_date("l_shipdate").alias("day"), "l_returnflag"
    )
    return rules.duplicate_observations(li, ["day", "l_returnflag"])


@query(
    "v02_mixed_time_kinds",
    """WITH x AS (SELECT user_id AS unit_id, CASE WHEN value > 250 THEN 'iso_naive' WHEN value > 200 THEN 'iso_aware' ELSE 'numeric' END AS kind FROM events)
SELECT unit_id, 'mixed_time_types' AS code, CAST(count(DISTINCT kind) AS VARCHAR) AS details FROM x GROUP BY 1 HAVING count(DISTINCT kind) > 1""",
)
def mixed_time(spark, base):
    e = tb.read(spark, base, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("value") > 250, iso).when(
        F.col("value") > 200, F.concat(iso, F.lit("+08:00"))
    ).otherwise(F.col("event_id").cast("string"))
    kinds = e.select(F.col("user_id").alias("unit_id"), sc.time_kind(text).alias("time_kind"))
    return rules.mixed_time_kinds(kinds)


@query(
    "v03_multiple_components",
    """WITH x AS (SELECT user_id AS unit_id, CASE WHEN value > 200 THEN event_type WHEN value < 5 THEN ' ' ELSE 'A' END AS c FROM events)
SELECT unit_id, 'multiple_component_ids' AS code, CAST(count(DISTINCT c) AS VARCHAR) AS details FROM x WHERE trim(c) <> '' GROUP BY 1 HAVING count(DISTINCT c) > 1""",
)
def components(spark, base):
    e = tb.read(spark, base, "events").select(
        F.col("user_id").alias("unit_id"),
        F.when(F.col("value") > 200, F.col("event_type")).when(F.col("value") < 5, " ").otherwise("A").alias("c"),
    )
    return rules.multiple_components(e, "c")


@query(
    "v04_inconsistent_units",
    "WITH" + READINGS + "," + UNITS_SQL + """
SELECT unit_id, 'inconsistent_channel_unit' AS code, channel AS details FROM du GROUP BY unit_id, channel HAVING count(DISTINCT declared_unit) > 1""",
)
def inconsistent_units(spark, base):
    return rules.inconsistent_units(declared_units(spark, base))


@query(
    "v04_unit_mismatch",
    "WITH" + READINGS + "," + UNITS_SQL + """
SELECT DISTINCT unit_id, 'model_channel_unit_mismatch' AS code, channel || '|' || declared_unit AS details FROM du WHERE declared_unit = 'mAh'""",
)
def unit_mismatch(spark, base):
    expected = joins.dimension(spark, list(fv.CHANNEL_UNITS.items()), "channel string, expected_unit string")
    aliases = joins.alias_table(spark, fv.UNIT_ALIASES, sc.name_key)
    return rules.unit_mismatch(declared_units(spark, base), expected, aliases)


@query(
    "v04_ambiguous_wide_unit",
    "SELECT c_name AS unit_id, 'ambiguous_wide_unit' AS code, '2' AS details FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def ambiguous_wide_unit(spark, base):
    c = tb.read(spark, base, "customer")
    n = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("unit"), F.lit("channel"), F.lit("channel"))).otherwise(
        F.array(F.lit("unit"), F.lit("channel"))
    )
    return rules.ambiguous_wide_unit(c.select(F.col("c_name").alias("source"), F.explode(n).alias("semantic")))


@query(
    "v05_incomplete_steps",
    "WITH" + READINGS + """,
s AS (SELECT unit_id, CAST(floor(t / 86400) AS BIGINT) AS t, list_sort(list(DISTINCT channel)) AS have FROM ev WHERE channel IN ('click', 'error', 'view') GROUP BY 1, 2),
m AS (SELECT unit_id, t, [c FOR c IN ['click', 'error', 'view'] IF NOT list_contains(have, c)] AS missing FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY unit_id) AS n_steps FROM m WHERE len(missing) > 0)
SELECT unit_id, 'incomplete_time_steps' AS code, max(n_steps) AS n_steps,
       string_agg(t || ':' || array_to_string(missing, '+'), ';' ORDER BY t) AS examples FROM r WHERE rn <= 5 GROUP BY 1""",
)
def incomplete_steps(spark, base):
    ev = tb.event_readings(spark, base).withColumn("t", F.floor(F.col("t") / 86400))
    out = rules.incomplete_steps(ev, Axis(("unit_id",), ("t",)), ["click", "error", "view"])
    shown = F.transform("examples", lambda s: F.concat_ws(":", s["t"].cast("string"), F.array_join(s["missing"], "+")))
    return out.select("unit_id", "code", "n_steps", F.array_join(shown, ";").alias("examples"))


@query(
    "v06_index_axis",
    "WITH" + STEPS + """,
x AS (SELECT unit_id, step + CASE unit_id % 5 WHEN 1 THEN CAST(step >= 20 AS INTEGER) WHEN 2 THEN 0.25 * CAST(step = 7 AS INTEGER) WHEN 3 THEN 2 WHEN 4 THEN -1 ELSE 0 END AS t FROM st),
p AS (SELECT *, lag(t) OVER (PARTITION BY unit_id ORDER BY t) AS pt FROM x),
f AS (SELECT unit_id, count(*) FILTER (abs(t - round(t)) > 1e-9) AS ni, count(*) FILTER (round(t) < 0) AS neg, min(round(t)) AS first,
             min(CASE WHEN pt IS NOT NULL AND round(t) <> round(pt) + 1 THEN round(pt) + 1 END) AS gap FROM p GROUP BY 1)
SELECT unit_id, 'index_not_integer' AS code, CAST(ni AS DOUBLE) AS detail FROM f WHERE ni > 0
UNION ALL SELECT unit_id, 'index_negative', CAST(neg AS DOUBLE) FROM f WHERE neg > 0
UNION ALL SELECT unit_id, 'index_origin', CAST(first AS DOUBLE) FROM f WHERE first <> 0
UNION ALL SELECT unit_id, 'time_gap', CAST(gap AS DOUBLE) FROM f WHERE gap IS NOT NULL""",
)
def index_axis(spark, base):
    axis = tb.event_axis(spark, base)
    st = tb.event_steps(spark, base, axis)
    u, s = F.col("unit_id") % 5, F.col("step").cast("double")
    t = (
        F.when(u == 1, s + (s >= 20).cast("int"))
        .when(u == 2, s + 0.25 * (s == 7).cast("int"))
        .when(u == 3, s + 2)
        .when(u == 4, s - 1)
        .otherwise(s)
    )
    return rules.index_axis(st.select("unit_id", t.alias("t")), axis.dense("t"))


@query(
    "v07_bin_axis",
    "WITH" + READINGS + """,
b AS (SELECT unit_id, CAST(floor(t / 86400) AS BIGINT) AS bin, count(DISTINCT channel) FILTER (channel IN ('click', 'view')) AS n FROM ev GROUP BY 1, 2),
p AS (SELECT *, lag(bin) OVER (PARTITION BY unit_id ORDER BY bin) AS pb FROM b)
SELECT unit_id, count(*) FILTER (bin < 0) AS n_negative, min(bin) AS first_bin, min(CASE WHEN pb IS NOT NULL AND bin <> pb + 1 THEN pb + 1 END) AS first_missing_bin,
       count(*) FILTER (n < 2) AS n_incomplete, min(bin) FILTER (n < 2) AS first_incomplete FROM p GROUP BY 1""",
)
def bin_axis(spark, base):
    ev = tb.event_readings(spark, base)
    required = ["click", "view"]
    bins = ev.groupBy("unit_id", sc.bin_index(F.col("t"), 86400.0).alias("bin")).agg(
        F.collect_set(F.when(F.col("channel").isin(*required), F.col("channel"))).alias("have")
    )
    return rules.bin_axis(bins, Axis(("unit_id",), ("bin",)), required)


@query(
    "v08_history_length",
    """WITH n AS (SELECT user_id AS unit_id, count(*) AS n FROM events GROUP BY 1)
SELECT unit_id, 'insufficient_history' AS code, CAST(n AS VARCHAR) AS details FROM n WHERE n < 60
UNION ALL SELECT unit_id, 'too_many_windows', CAST((n - 60) // 5 + 1 AS VARCHAR) FROM n WHERE n >= 60 AND (n - 60) // 5 + 1 > 3""",
)
def history_length(spark, base):
    return rules.history_length(tb.event_readings(spark, base), 60, 5, max_windows=3)


@query(
    "v09_name_rules",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN '  ' WHEN p_size > 45 THEN repeat(p_name, 20) ELSE p_name END AS channel_text FROM part)
SELECT p_partkey, CASE WHEN trim(channel_text) = '' THEN 'empty_telemetry' ELSE 'telemetry_name_too_long' END AS code FROM x
WHERE trim(channel_text) = '' OR length(trim(channel_text)) > 160""",
)
def name_rules(spark, base):
    p = tb.read(spark, base, "part").select(
        "p_partkey",
        F.when(F.col("p_size") < 5, "  ").when(F.col("p_size") > 45, F.repeat("p_name", 20)).otherwise(F.col("p_name")).alias("channel_text"),
    )
    return rules.name_rules(p).select("p_partkey", "code")


@query(
    "v09_empty_wide_rows",
    """SELECT l_orderkey, l_linenumber, l_suppkey, 'empty_wide_observation' AS code FROM lineitem WHERE l_tax = 0 AND l_discount = 0""",
)
def empty_wide(spark, base):
    li = tb.read(spark, base, "lineitem")
    w = li.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        *[F.when(F.col(c) != 0, F.col(c)).alias(c) for c in ("l_tax", "l_discount")],
    )
    return rules.empty_wide_rows(w, ["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", "l_suppkey", "code")


@query(
    "v09_row_width",
    """SELECT p_partkey, 'row_column_count' AS code FROM part WHERE len(string_split(p_name, ' ')) <> 2 OR p_size > 40""",
)
def row_width(spark, base):
    p = tb.read(spark, base, "part")
    line = F.when(F.col("p_size") > 40, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name"))
    cells = p.select("p_partkey", F.split(line, " ").alias("cells"))
    return rules.row_width(cells, 2).select("p_partkey", "code")


@query(
    "v10_size_caps",
    """WITH f AS (SELECT s_nationkey AS batch, s_name AS source, sum(l_quantity)::BIGINT AS bytes, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS n_columns, count(*) AS n_records
           FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT batch, source, 'file_too_large' AS code FROM f WHERE bytes > 15500
UNION ALL SELECT batch, source, 'telemetry_table_columns_required' FROM f WHERE n_columns < 2 OR n_columns > 6
UNION ALL SELECT batch, source, 'too_many_records' FROM f WHERE n_records > 620
UNION ALL SELECT batch, NULL, 'too_many_files' FROM f GROUP BY 1 HAVING count(*) > 4
UNION ALL SELECT batch, NULL, 'batch_too_large' FROM f GROUP BY 1 HAVING sum(bytes) > 60000""",
)
def size_caps(spark, base):
    li = tb.read(spark, base, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").cast("bigint").alias("bytes"),
        F.count_distinct("l_linenumber").alias("n_columns"),
        F.count(F.lit(1)).alias("n_records"),
    )
    s = tb.read(spark, base, "supplier")
    files = li.join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("s_nationkey").alias("batch"), F.col("s_name").alias("source"), "bytes", "n_columns", "n_records"
    )
    return rules.size_caps(files, 4, 15500, 60000, 6, 620)


@query(
    "v11_sample_grid",
    "WITH" + SUPPLIER_DAYS + """,
p AS (SELECT unit_id, t, t - lag(t) OVER (PARTITION BY unit_id ORDER BY t) AS d FROM sd)
SELECT unit_id, count(*) FILTER (d <= 0) AS n_not_rising, count(*) FILTER (abs(d - 1.0) > 1e-6) AS n_off_grid, abs(min(t)) < 1e-12 AS starts_at_zero FROM p GROUP BY 1""",
)
def sample_grid(spark, base):
    return rules.sample_grid(tb.supplier_days(spark, base), tb.DAY_AXIS, 1.0)


@query(
    "v12_finite_and_aligned",
    """SELECT user_id AS unit_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'click' AND value > 150) AS bad_click,
       count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'view' AND value > 150) AS bad_view,
       count(*) FILTER (event_type = 'click') = count(*) FILTER (event_type = 'view') AS aligned FROM events GROUP BY 1""",
)
def finite_aligned(spark, base):
    ev = tb.event_readings(spark, base)
    v = F.when(F.col("value") > 250, float("inf")).when(F.col("value") > 150, float("nan")).otherwise(F.col("value"))
    return rules.finite_and_aligned(ev.withColumn("value", v), ["click", "view"])


@query(
    "v13_monotone",
    "WITH" + STEPS + """,
p AS (SELECT unit_id, value - lag(value) OVER w AS dv, k - lag(k) OVER w AS dk FROM st WINDOW w AS (PARTITION BY unit_id ORDER BY step))
SELECT unit_id, count(*) FILTER (dv < -1.5) AS value_breaks, count(*) FILTER (dk > 0.5) AS k_breaks FROM p GROUP BY 1""",
)
def monotone(spark, base):
    axis = tb.event_axis(spark, base)
    return rules.monotone(tb.event_steps(spark, base, axis), axis, {"value": 1.5}, {"k": 0.5})


@query(
    "v14_label_identity",
    "WITH" + STEPS + """,
x AS (SELECT unit_id, CASE WHEN unit_id % 4 = 0 THEN NULL ELSE n_steps END AS ft, step AS t, k FROM st),
y AS (SELECT *, CASE WHEN ft IS NULL THEN CASE WHEN unit_id % 8 = 4 AND t = 3 THEN 1e0 END ELSE ft - t + CASE WHEN unit_id % 4 = 1 AND t = 5 THEN 5e-1 ELSE 0e0 END END AS rul FROM x)
SELECT unit_id, max(abs(rul - (ft - t))) AS max_gap, coalesce(max(abs(rul - (ft - t))), 0) <= 2e-4 AS carried, coalesce(max(abs(rul - (ft - t))), 0) <= 1e-6 AS strict,
       max(ft) IS NOT NULL OR count(rul) = 0 AS censoring_ok FROM y GROUP BY 1""",
)
def label_identity(spark, base):
    st = tb.event_steps(spark, base)
    u, t = F.col("unit_id"), F.col("step").cast("double")
    ft = F.when(u % 4 != 0, F.col("n_steps").cast("double"))
    rul = F.when(ft.isNull(), F.when((u % 8 == 4) & (t == 3), 1.0)).otherwise(
        ft - t + F.when((u % 4 == 1) & (t == 5), 0.5).otherwise(0.0)
    )
    rows = st.select("unit_id", t.alias("t"), rul.alias("rul"), F.lit(0).alias("fail"), ft.alias("failure_time"))
    return rules.label_identity(rows)


@query(
    "v15_sample_identities",
    "WITH" + STEPS + """
SELECT unit_id, count(*) FILTER (value / 100.0 > 1.5 + 1e-9) AS hi_range, count(*) FILTER (k > 95) AS cycle_index, count(*) FILTER (hour = 3) AS lli,
       count(*) FILTER (hour = 5) AS lam FROM st GROUP BY 1""",
)
def sample_identities(spark, base):
    st = tb.event_steps(spark, base)
    expected = F.floor(F.col("t") / 5740.0 + 1e-9)
    rows = st.select(
        "unit_id", "t",
        (expected + (F.col("k") > 95).cast("int")).alias("cycle_index"),
        (F.col("value") / 100.0).alias("hi"),
        F.lit(0.9).alias("soh"),
        (F.lit(0.1) + F.when(F.col("hour") == 3, 1e-3).otherwise(0.0)).alias("lli"),
        F.when(F.col("hour") == 5, 1e-3).otherwise(0.0).alias("lam"),
    )
    return rules.sample_identities(rows)


@query(
    "v16_unknown_codes",
    "SELECT c_custkey, c_nationkey AS code FROM customer WHERE c_nationkey NOT IN (0, 1, 2, 3, 11, 12)",
)
def unknown_codes(spark, base):
    c = tb.read(spark, base, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    return rules.unknown_codes(c, "code", list(fv.FAILURE_CODES))


@query(
    "v16_metadata_agrees",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'k,empty' ELSE 'empty' END AS differing FROM events WHERE value > 120
       UNION ALL SELECT event_id, 'k' FROM events WHERE value <= 120 AND event_type = 'error'""",
)
def metadata_agrees(spark, base):
    e = tb.read(spark, base, "events")
    k = F.get_json_object("props", "$.k")
    rows = e.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(k, F.lit("x"))).otherwise(k).alias("k"),
        F.when(F.col("value") > 120, "").otherwise("note").alias("empty"),
        F.concat(F.substring_index("props", "}", 1), F.lit(', "empty": "note"}')).alias("meta_json"),
    )
    return rules.metadata_agrees(rows, ["k", "empty"]).select("event_id", F.array_join("differing", ",").alias("differing"))


@query(
    "v16_exact_attributes",
    """SELECT o_orderkey, o_orderstatus <> 'P' AS exact FROM orders""",
)
def exact_attributes(spark, base):
    o = tb.read(spark, base, "orders")
    names = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("failure_mode_code"), F.lit("criterion_text"))).otherwise(
        F.array(F.lit("failure_time_days"), F.lit("failure_mode_code"), F.lit("criterion_text"))
    )
    return o.select("o_orderkey", rules.exact_attributes(names).alias("exact"))


@query(
    "v17_split_overlap",
    """SELECT DISTINCT user_id AS unit_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 300) AND user_id IN (SELECT user_id FROM events WHERE value < 0.1)""",
)
def split_overlap(spark, base):
    ev = tb.event_readings(spark, base)
    return rules.split_overlap(ev.where("value > 300"), ev.where("value < 0.1"))


@query(
    "v18_holdout_leaks",
    """SELECT DISTINCT o_custkey AS unit_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def holdout_leaks(spark, base):
    used = tb.read(spark, base, "orders").select(F.col("o_custkey").alias("unit_id"))
    held = tb.read(spark, base, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("unit_id"))
    return rules.holdout_leaks(used, held)


@query(
    "v19_manifest_audit",
    """WITH g AS (SELECT DISTINCT doc_id % 40 AS g FROM documents)
SELECT 'group' || g || '.txt' AS path, CASE g % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'changed' WHEN 2 THEN 'extra' ELSE 'changed' END AS state FROM g
UNION ALL SELECT 'gone' || g || '.txt', 'missing' FROM g WHERE g % 4 = 0""",
)
def manifest_audit(spark, base):
    """Files written from the table, read back as bytes, against a manifest made from the table: some
    entries have another digest, another size, or no file, and some files no entry."""
    path = f"{storage.checkpoint_folder(spark)}/audited-{uuid.uuid4().hex}"
    d = tb.read(spark, base, "documents").select("doc_id", (F.col("doc_id") % 40).alias("g"), F.coalesce("text", F.lit("")).alias("text"))
    fixtures.write_each(d, "g", path, fixtures.text_file).collect()
    stored = spark.read.format("binaryFile").load(path)
    found = stored.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    whole = d.groupBy("g").agg(F.array_join(texts, "\n").alias("whole"))
    sha, size, kind = F.sha2("whole", 256), F.octet_length("whole").cast("bigint"), F.col("g") % 4
    named = lambda stem: F.concat(F.lit(stem), F.col("g").cast("string"), F.lit(".txt")).alias("path")
    listed = whole.where(kind != 2).select(
        named("group"), F.when(kind == 3, size + 1).otherwise(size).alias("expected_bytes"), F.when(kind == 1, F.reverse(sha)).otherwise(sha).alias("expected_sha256")
    )
    gone = whole.where(kind == 0).select(named("gone"), size.alias("expected_bytes"), sha.alias("expected_sha256"))
    return ledger.manifest_audit(found, listed.unionByName(gone))


@query(
    "v19_inside_root",
    """WITH x AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages),
y AS (SELECT page_id, CASE WHEN p LIKE 'm.%' THEN '../' || p WHEN p LIKE '%.org%' THEN 'old/' || p ELSE p END AS q FROM x)
SELECT page_id, CASE WHEN q LIKE 'old/%' THEN 'new/' || substr(q, 5) ELSE q END AS relative, q NOT LIKE '../%' AS inside FROM y""",
)
def inside_root(spark, base):
    p = F.regexp_replace("url", "^https?://", "")
    q = F.when(p.startswith("m."), F.concat(F.lit("../"), p)).when(
        p.contains(".org"), F.concat(F.lit("old/"), p)
    ).otherwise(p)
    rows = tb.read(spark, base, "pages").select("page_id", q.alias("q"))
    relative, inside = ledger.inside_root(F.col("q"), {"old/": "new/"})
    return rows.select("page_id", relative.alias("relative"), inside.alias("inside"))


@query(
    "v20_record_differences",
    """WITH b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS p FROM orders)
SELECT o.o_orderkey, concat_ws(',', CASE WHEN s <> o_orderstatus THEN 'o_orderstatus' END, CASE WHEN p IS NULL THEN 'o_orderpriority' END) AS differing,
       s = o_orderstatus AND p IS NOT NULL AS reusable FROM orders o JOIN b USING (o_orderkey)""",
)
def record_differences(spark, base):
    o = tb.read(spark, base, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    other = o.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return ledger.record_differences(o, other, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(
    "v21_stored_differences",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal END AS balance, 'stored' AS only_in FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0
UNION ALL SELECT c_custkey, c_acctbal + 1, 'computed' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0""",
)
def stored_differences(spark, base):
    c = tb.read(spark, base, "customer")
    b = F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal"))
    moved = F.when(F.col("c_mktsegment") == "BUILDING", b + 1).otherwise(b)
    return ledger.stored_differences(
        c.select("c_custkey", b.alias("balance")), c.select("c_custkey", moved.alias("balance"))
    )


_LANES = ", ".join(f"sum(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT))::BIGINT AS s{i}" for i in range(8))
_FINGER = """sha256(concat_ws('-', n, s0, s1, s2, s3, s4, s5, s6, s7))"""


@query(
    "v22_content_fingerprint",
    f"""WITH r AS (SELECT user_id AS unit_id, sha256('=' || event_id || chr(31) || '=' || event_type || chr(31) || coalesce('=' || props, '~')) AS d FROM events),
l AS (SELECT unit_id, count(*) AS n, {_LANES} FROM r GROUP BY 1) SELECT unit_id, n AS n_rows, {_FINGER} AS fingerprint FROM l""",
)
def fingerprint(spark, base):
    e = tb.read(spark, base, "events").withColumnRenamed("user_id", "unit_id")
    return ledger.fingerprint(e, [F.col("event_id"), F.col("event_type"), F.col("props")], ["unit_id"])


@query(
    "v23_unchanged_snapshot",
    """SELECT DISTINCT user_id AS unit_id, true AS moved FROM events WHERE value > 300""",
)
def unchanged(spark, base):
    e = tb.read(spark, base, "events").withColumnRenamed("user_id", "unit_id")
    columns = [F.col("event_id"), F.col("value")]
    before = ledger.fingerprint(e, columns, ["unit_id"])
    after = ledger.fingerprint(e.withColumn("value", F.least("value", F.lit(300.0))), columns, ["unit_id"])
    return ledger.unchanged(before, after, ["unit_id"]).select("unit_id", F.lit(True).alias("moved"))


@query(
    "v24_prediction_quality",
    """WITH r AS (SELECT user_id AS unit_id, event_id AS window_id, CASE WHEN event_type = 'view' THEN 'val' ELSE 'holdout' END AS split,
             CASE WHEN value > 200 THEN NULL ELSE value END AS p10, value + 5 AS p50, CASE WHEN event_type = 'error' THEN value ELSE value + 9 END AS p90,
             CASE WHEN value < 10 THEN NULL ELSE 1.0 END AS r1, CASE WHEN value < 20 THEN NULL ELSE 1.0 END AS r2, value BETWEEN 50 AND 60 AS clamped FROM events)
SELECT count(*) FILTER (split = 'holdout' AND p10 IS NULL) AS invalid_rows, count(*) FILTER (split <> 'holdout') AS non_holdout_rows,
       count(*) FILTER (split = 'holdout' AND p10 IS NOT NULL AND p50 > p90) AS quantile_crossings,
       count(*) FILTER (split = 'holdout' AND p10 IS NOT NULL AND r1 IS NULL) AS missing_reference_1,
       count(*) FILTER (split = 'holdout' AND p10 IS NOT NULL AND r2 IS NULL) AS missing_reference_2,
       count(*) FILTER (split = 'holdout' AND p10 IS NOT NULL AND clamped) AS clamped_rows FROM r""",
)
def prediction_quality(spark, base):
    e = tb.read(spark, base, "events")
    v = F.col("value")
    rows = e.select(
        F.col("user_id").alias("unit_id"), F.col("event_id").alias("window_id"),
        F.when(F.col("event_type") == "view", "val").otherwise("holdout").alias("split"),
        F.col("event_id").cast("double").alias("t_end"), v.alias("y_true"),
        F.when(v <= 200, v).alias("p10"), (v + 5).alias("p50"),
        F.when(F.col("event_type") == "error", v).otherwise(v + 9).alias("p90"),
        F.when(v >= 10, 1.0).alias("reference_1"), F.when(v >= 20, 1.0).alias("reference_2"),
        v.between(50, 60).alias("clamped"),
    )
    return rules.prediction_quality(rows)


@query(
    "v25_window_shape",
    """SELECT vec_id AS unit_id, 'model_shape_mismatch' AS code FROM embeddings WHERE label = 1""",
)
def window_shape(spark, base):
    w = tb.embedding_windows(spark, base)
    cut = F.transform("x", lambda row, i: F.when((F.col("y") == 1) & (i == 7), F.slice(row, 1, 3)).otherwise(row))
    return rules.window_shape(w.withColumn("x", cut), 16, 4).select("unit_id", "code")


@query(
    "v26_seed_contract",
    """WITH e AS (SELECT c_nationkey AS component, unnest([17, 42, CASE WHEN min(c_acctbal) < -950 THEN 99 ELSE 73 END]) AS seed, max(c_mktsegment) = min(c_mktsegment) AS short FROM customer GROUP BY 1)
SELECT component, max(seed) = 73 AS seeds_ok, true AS digests_ok FROM e GROUP BY 1""",
)
def seed_contract(spark, base):
    c = tb.read(spark, base, "customer")
    low = c.groupBy(F.col("c_nationkey").alias("component")).agg(F.min("c_acctbal").alias("b"))
    entries = low.select(
        "component",
        F.explode(F.array(F.lit(17), F.lit(42), F.when(F.col("b") < -950, 99).otherwise(73))).alias("seed"),
        F.sha2(F.col("component").cast("string"), 256).alias("digest"),
    )
    return rules.seed_contract(entries)


@query(
    "v27_contract_differences",
    """WITH a AS (SELECT p_brand, count(*) AS length, max(p_size) AS width, min(p_retailprice) AS rmax FROM part GROUP BY 1)
SELECT p_brand, concat_ws(',', CASE WHEN length > 80 THEN 'length' END, CASE WHEN rmax > 905 THEN 'rmax' END) AS differing FROM a""",
)
def contract_differences(spark, base):
    a = tb.read(spark, base, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("length"), F.max("p_size").alias("width"), F.min("p_retailprice").alias("rmax")
    )
    b = a.select(
        "p_brand", F.least("length", F.lit(80)).alias("length"), "width", F.least("rmax", F.lit(905.0)).alias("rmax")
    )
    return rules.contract_differences(a, b, "p_brand", ["length", "width", "rmax"])


@query(
    "v_violations_table",
    "WITH" + READINGS + """,
v AS (SELECT DISTINCT unit_id FROM ev GROUP BY unit_id HAVING count(*) < 60 UNION SELECT unit_id FROM ev WHERE channel = 'error' AND value > 150)
SELECT unit_id, count(*) AS n_rows FROM ev WHERE unit_id NOT IN (SELECT unit_id FROM v) GROUP BY 1""",
)
def violations_table(spark, base):
    ev = tb.event_readings(spark, base)
    found = rules.collect(
        rules.history_length(ev, 60, 5),
        ev.where("channel = 'error' and value > 150").select(
            *rules.violation(F.col("unit_id"), "value_over_limit", F.col("value"))
        ),
    )
    return rules.valid_units(ev, found).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_rows"))
