"""The whole way from uploaded text cells to predictions and a status per unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifespan.config import BATTERY
from lifespan.operators.segments import Axis
from lifespan.plans import prepare, scoring
from lifespan.plans.registry import STEPS, query
from lifespan.plans.score_queries import closed_form
from lifespan.sources import tables as tb

LENGTH, STRIDE = BATTERY.length, BATTERY.stride


def upload_cells(spark, base):
    """Events as the text cells of batteries, one cycle an event, with a fault in some units.

    By ``unit_id % 11``: 1 has a cell that is no number, 2 lacks a cycle, 3 lacks a channel in a
    cycle, 4 repeats a reading under another spelling of its time, 5 sends a refused channel.
    Even units spell one channel in full width.
    """
    st = tb.event_steps(spark, base).withColumn("fault", F.col("unit_id") % 11)
    capacity = F.when(F.col("unit_id") % 2 == 0, "ｃａｐａｃｉｔｙ＿ａｈ").otherwise("capacity_ah")
    step = F.col("step").cast("string")

    def cell(when, label, text, time=step):
        return F.when(when, F.struct(time.alias("time_text"), label.alias("channel_text"), text.alias("value_text")))

    here = ~((F.col("fault") == 2) & (F.col("step") == 7))
    broken = (F.col("fault") == 1) & (F.col("step") == 5)
    cells = F.array(
        cell(here, capacity, F.when(broken, "n/a").otherwise(F.col("value").cast("string"))),
        cell(here & ~((F.col("fault") == 3) & (F.col("step") == 9)), F.lit("bat.temp_mean_c"), F.col("hour").cast("string")),
        cell(here, F.lit("bat.charge_time_s"), F.col("k").cast("string")),
        cell((F.col("fault") == 4) & (F.col("step") == 0), capacity, F.lit("1.5"), F.lit("-0")),
        cell((F.col("fault") == 5) & (F.col("step") == 0), F.lit("bat.ir_proxy_ohm"), F.lit("0.1")),
    )
    each = st.select(F.col("unit_id").cast("string").alias("unit_id"), F.explode(F.array_compact(cells)).alias("c"))
    return each.select("unit_id", "c.*")


@query(
    "m10_upload_status",
    "WITH" + STEPS + f""", n AS (SELECT unit_id, count(*) AS n, unit_id % 11 AS f FROM st GROUP BY ALL),
c AS (SELECT *, CASE WHEN f = 1 AND n > 5 THEN 'invalid_value' WHEN f = 4 THEN 'duplicate_observation' WHEN f = 5 THEN 'unsupported_bat_ir_proxy_present'
 WHEN f = 3 AND n > 9 THEN 'incomplete_time_steps' WHEN f = 2 AND n > 8 THEN 'bat_cycle_time_gap' WHEN n < {LENGTH} THEN 'insufficient_history' END AS code FROM n)
SELECT CAST(unit_id AS VARCHAR) AS unit_id, code, code IS NULL AS predicted, CASE WHEN code IS NULL THEN (n - {LENGTH}) // {STRIDE} + 1 END AS n_windows,
 CASE WHEN code IS NULL THEN {LENGTH - 1} + (n - {LENGTH}) // {STRIDE} * {STRIDE} + 0e0 END AS last_t, CASE WHEN code IS NULL THEN true END AS in_range FROM c""",
)
def upload_status(spark, base):
    """Per submitted unit: predicted or the first code, its windows, the last of them, scores in range."""
    parsed, steps, violations = prepare.battery_upload(spark, upload_cells(spark, base))
    plan = prepare.scoring_plan(BATTERY)
    fitted = scoring.step_statistics(steps, plan.channels, F.max("age").alias("age_scale"))
    axis = Axis.fit(steps, ("unit_id",), ("step",)).dense("window_index")
    scored = scoring.predict_batch(scoring.normalise_steps(steps, fitted, plan.channels), plan, closed_form, axis)
    windows = scored.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.max("t_end").alias("last_t"),
        F.bool_and(F.col("y_pred").between(0.0, plan.rmax)).alias("in_range"),
    )
    return prepare.file_status(parsed, violations).join(windows, "unit_id", "left")
