"""Golden values and NumPy cross-checks for features, cycles, preparation and scoring."""

import contextlib
import io
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.config import BATTERY, WHEEL, edge_length
from lifespan.functions import scalar as sc
from lifespan.operators import ensemble, features, mapping, rules, split, stats
from lifespan.operators.segments import Axis
from lifespan.plans import prepare, reconstruct, scoring


def numpy_statistics(x, edge):
    length = x.shape[1]
    t = np.linspace(-1, 1, length)
    parts = [
        x[:, -1], x[:, 0], x[:, -1] - x[:, 0], x.mean(1), x.std(1), x.min(1), x.max(1),
        *[np.quantile(x, q, axis=1) for q in (0.25, 0.5, 0.75)],
        np.einsum("l,nlc->nc", t, x) / (t * t).sum(), x[:, -edge:].mean(1), x[:, :edge].mean(1),
    ]
    return np.stack(parts, axis=1)


@pytest.mark.parametrize("length,channels", [(60, 4), (30, 13), (7, 2)])
def test_statistics_match_numpy(spark, length, channels):
    rng = np.random.default_rng(length)
    x = rng.normal(size=(5, length, channels))
    df = spark.createDataFrame([(i, float(i), x[i].tolist()) for i in range(5)], "id long, age double, x array<array<double>>")
    out = features.with_statistics(df, length, channels).select(
        "id",
        features.statistic_major().alias("s"),
        features.invariant_features("age", 4.0, channels).alias("inv"),
        features.flat_window().alias("flat"),
    ).orderBy("id").toPandas()
    want = numpy_statistics(x, edge_length(length))
    assert np.allclose(np.stack(out["s"]), want.reshape(5, -1))
    assert np.allclose(np.stack(out["flat"]), x.reshape(5, -1))
    ratio = np.arange(5) / 4.0
    invariant = np.concatenate(
        [want.mean(2), want.std(2), want.min(2), want.max(2), np.stack([ratio, ratio**2, np.sqrt(ratio)], 1)], axis=1
    )
    assert np.allclose(np.stack(out["inv"]), invariant)
    assert len(features.feature_names([f"c{i}" for i in range(channels)])) == channels * 13 + 3


def test_feature_sizes_of_the_contracts():
    assert BATTERY.edge == 8 and WHEEL.edge == 6
    assert len(WHEEL.channels) == 13 and len(features.invariant_names()) == 55


def test_member_interval_matches_numpy(spark):
    rng = np.random.default_rng(2)
    members = rng.normal(0.5, 0.4, size=(12, 3))
    df = spark.createDataFrame(
        [("u", i, *map(float, m)) for i, m in enumerate(members)], "unit_id string, window_index long, m17 double, m42 double, m73 double"
    )
    axis = Axis(("unit_id",), ("window_index",), 1000.0)
    out = ensemble.finish(df, axis, 150.0, postprocess="none").orderBy("window_index").toPandas()
    safe = np.clip(members, 0, 1) * 150
    point = np.clip(np.median(members, axis=1), 0, 1) * 150
    assert np.allclose(out["y_pred"], point)
    assert np.allclose(out["p10"], np.minimum(np.quantile(safe, 0.1, axis=1), point))
    assert np.allclose(out["p90"], np.maximum(np.quantile(safe, 0.9, axis=1), point))
    assert np.allclose(out["ensemble_std"], safe.std(axis=1))
    assert (out["clamped"] == (np.median(members, axis=1) * 150 != point)).all()
    iso = ensemble.finish(df, axis, 150.0).orderBy("window_index").toPandas()
    assert (np.diff(iso["y_pred"]) <= 1e-9).all()
    assert ((iso["p10"] <= iso["y_pred"]) & (iso["y_pred"] <= iso["p90"])).all()


def battery_samples(soh_at_settlement, q0=2.0):
    """Arrays of one battery whose SOH drops at every cycle border."""
    per = fv.SAMPLES_PER_ORBIT
    n = per * len(soh_at_settlement) + 1
    k = np.arange(n) // per
    soh = np.array([1.0, *soh_at_settlement])[k]
    current = np.where(np.arange(n) % per < 200, -1.0, 0.5)
    hi = np.maximum(0, (1 - soh) / 0.2)
    return {
        "unit_id": "BAT_dev_S001", "t_days": (np.arange(n) * 10.0 / 86400).tolist(), "current": current.tolist(),
        "temp": (25.0 + k).tolist(), "soh": soh.tolist(), "hi": hi.tolist(), "lli": (1 - soh).tolist(), "lam": [0.0] * n,
        "cycle_index": k.tolist(), "fail": (soh <= 0.8).astype(int).tolist(),
    }


def explode(spark, sample):
    channels = [c for c in sample if c not in ("unit_id", "t_days")]
    types = {"cycle_index": "array<bigint>", "fail": "array<int>"}
    schema = "unit_id string, t_days array<double>, " + ", ".join(f"{c} {types.get(c, 'array<double>')}" for c in channels)
    df = spark.createDataFrame([tuple(sample[c] for c in ("unit_id", "t_days", *channels))], schema)
    return reconstruct.explode_samples(df, channels)


def test_cycle_reconstruction_golden(spark):
    rows = explode(spark, battery_samples([0.90, 0.83, 0.79, 0.775]))
    assert reconstruct.sample_violations(rows).count() == 0
    out = reconstruct.battery_cycles(rows).orderBy("cycle").toPandas()
    assert out["capacity"].round(9).tolist() == [1.80, 1.66, 1.58, 1.55]
    assert out["failure_cycle"].tolist() == [2, 2, 2, 2]
    assert out["rul"].tolist() == [2, 1, 0, -1]
    assert out["fail"].tolist() == [0, 0, 1, 1]
    assert out["charge_time"].tolist() == [2000.0] * 4 and out["hi_matches"].all()
    assert out["c_rate_mean"].round(9).tolist() == [round((200 * 1.0 + 374 * 0.5) / 574 / 2, 9)] * 4


def test_censored_battery(spark):
    out = reconstruct.battery_cycles(explode(spark, battery_samples([0.97, 0.95, 0.93]))).toPandas()
    assert out["censored"].all() and out["rul"].isna().all() and (out["fail"] == 0).all()


def test_broken_sample_is_reported(spark):
    sample = battery_samples([0.90, 0.83])
    sample["t_days"][5] = sample["t_days"][4]
    assert reconstruct.sample_violations(explode(spark, sample)).first().code == "time_grid"


def battery_text(unit, n, skip=()):
    rows = []
    for i in range(n):
        if i in skip:
            continue
        for name, v in (("capacity_ah", 2.5 - 0.0035 * i), ("Battery Temperature_C", 25 + 0.035 * i), ("充电时间(秒)", 4200 - 3 * i)):
            rows.append((unit, str(i), name, repr(v)))
    return rows


def wheel_text(unit, bins):
    rows = []
    for b in range(bins):
        for o in (0, 300):
            t = 574 * b + o
            for name, v in (("rw.speed_rpm", 1200 - 1.8 * b + 0.02 * o), ("rw.motor_current_a", 0.42 + 0.002 * b + 0.0001 * o), ("rw.bearing_temp_c", 35 + 0.08 * b + 0.002 * o)):
                rows.append((unit, str(t), name, repr(v)))
    return rows


RAW = "unit_id string, time_text string, channel_text string, value_text string"


def constant_members(w):
    for s in fv.MEMBER_SEEDS:
        w = w.withColumn(f"tree_{s}", F.lit(0.5)).withColumn(f"direct_{s}", F.lit(0.25))
    return w


def score_steps(steps, contract):
    plan = prepare.scoring_plan(contract)
    fitted = scoring.step_statistics(steps, plan.channels)
    return scoring.predict_batch(scoring.normalise_steps(steps, fitted, plan.channels), plan, constant_members)


def test_battery_upload_end_to_end(spark):
    raw = battery_text("good", 90) + battery_text("gap", 90, skip=(40,)) + battery_text("short", 20) + wheel_text("wheel", 40)
    raw += battery_text("doubled", 60) + [("doubled", "-0", "capacity_ah", "2.0")] + battery_text("bad", 60) + [("bad", "60", "capacity_ah", "nan")]
    parsed = prepare.parse_readings(spark, spark.createDataFrame(raw, RAW))
    refused = prepare.parse_violations(parsed)
    routes = prepare.route_units(parsed)
    mine = parsed.join(refused.select("unit_id").distinct(), "unit_id", "left_anti").join(
        routes.where("route = 'battery'").select("unit_id"), "unit_id", "left_semi"
    )
    steps, violations = prepare.prepare_battery(mine)
    codes = {r.unit_id: r.code for r in prepare.first_codes(refused.unionByName(violations)).collect()}
    assert codes == {"gap": "bat_cycle_time_gap", "short": "insufficient_history", "doubled": "duplicate_observation", "bad": "nonfinite_value"}
    out = score_steps(steps, BATTERY).toPandas()
    assert out["unit_id"].tolist() == ["good"] * 7
    assert sorted(out["t_end"]) == [59.0, 64.0, 69.0, 74.0, 79.0, 84.0, 89.0]
    assert np.allclose(out["y_pred"], 150 * (0.2 * 0.25 + 0.8 * 0.5))
    status = prepare.file_status(mine, violations).toPandas().set_index("unit_id")
    assert status.loc["good", "predicted"] and not status.loc["gap", "predicted"]


def test_wheel_upload_end_to_end(spark):
    raw = wheel_text("good", 40) + [r for r in wheel_text("hole", 40) if not 574 * 5 <= float(r[1]) < 574 * 6]
    raw += [r for r in wheel_text("thin", 40) if not (r[2] == "rw.speed_rpm" and float(r[1]) in (574.0, 874.0))]
    raw += [(u, str(float(t) + 574), c, v) for u, t, c, v in wheel_text("late", 40)]
    parsed = prepare.parse_readings(spark, spark.createDataFrame(raw, RAW))
    assert {r.route for r in prepare.route_units(parsed).collect()} == {"wheel"}
    steps, violations = prepare.prepare_wheel_raw(parsed, "second", 0.1, 0.01)
    codes = {r.unit_id: r.code for r in prepare.first_codes(violations).collect()}
    assert codes == {"hole": "rwa_time_gap", "thin": "incomplete_rwa_bin", "late": "rwa_raw_time_origin"}
    first = steps.where("step = 0").first()
    assert first.rw_speed_rpm_mean == pytest.approx(1203.0) and first.rw_speed_rpm_std == pytest.approx(np.std([1200, 1206], ddof=1))
    assert first.rw_fric_tc_mean == pytest.approx(0.435 - (0.1 + 0.01 * 35.3))
    out = score_steps(steps, WHEEL).toPandas()
    assert len(out) == 11 and out["t_end"].min() == 574 * 29 + 300


def test_aggregated_wheel_upload(spark):
    raw = [("w", str(b), c, repr(1.0 + b)) for b in range(31) for c in fv.WHEEL_CHANNELS]
    parsed = prepare.parse_readings(spark, spark.createDataFrame(raw, RAW))
    steps, violations = prepare.prepare_wheel_bins(parsed)
    assert violations.count() == 0
    ages = [r.age for r in steps.orderBy("step").collect()]
    want = [np.floor(np.nextafter((i + 1) * 574.0, -np.inf) / 10) * 10 / 86400 for i in range(31)]
    assert np.allclose(ages, want)
    assert score_steps(steps, WHEEL).count() == 2


def test_absent_channel_is_refused(spark):
    raw = battery_text("u", 60) + [("u", "0", "bat.ir_proxy_ohm", "0.1")]
    _, violations = prepare.prepare_battery(prepare.parse_readings(spark, spark.createDataFrame(raw, RAW)))
    assert "unsupported_bat_ir_proxy_present" in {r.code for r in violations.collect()}


def test_normaliser_imputes_and_counts(spark):
    df = spark.createDataFrame([("u", "a", 1.0), ("u", "a", 3.0), ("u", "b", float("nan")), ("u", "b", 5.0)], "unit_id string, channel string, value double")
    fitted = stats.fit_norm_stats(df, ["a", "b"])
    out = {(r.channel, str(r.value)): (r.norm, r.imputed) for r in stats.apply_norm(df, fitted, ["a", "b"]).collect()}
    assert out["a", "1.0"] == (-1.0, False) and out["b", "nan"] == (0.0, True) and out["b", "5.0"] == (0.0, False)


def test_aliases_have_one_meaning(spark):
    from lifespan.operators import joins

    for table in (mapping.header_aliases(spark), mapping.channel_aliases(spark), mapping.metadata_aliases(spark)):
        assert joins.ambiguous_aliases(table).count() == 0


def test_full_width_names(spark):
    df = spark.createDataFrame([("Ｃａｐａｃｉｔｙ＿ＡＨ",), ("容量（Ah）",)], "label string")
    out = {r.label: r.key for r in mapping.normalise_names(df, "label", "key").collect()}
    assert list(out.values()) == ["capacityah", "容量ah"]


def test_bin_index_uses_half_open_bins(spark):
    df = spark.createDataFrame([(0.0,), (573.999,), (574.0,), (-0.5,)], "s double")
    assert [r[0] for r in df.select(sc.bin_index(F.col("s"))).collect()] == [0, 0, 1, -1]


def test_battery_upload_reads_its_input_once(spark):
    """Labels, checks, steps and status all go on from rows that were written."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    raw = battery_text("good", 90) + battery_text("gap", 90, skip=(40,)) + battery_text("short", 20) + wheel_text("wheel", 40)
    cells = spark.createDataFrame(raw, RAW)
    cells = cells.select("unit_id", *[counted(c).alias(c) for c in ("time_text", "channel_text", "value_text")])
    parsed, steps, violations = prepare.battery_upload(spark, cells)
    assert score_steps(steps, BATTERY).count() == 7
    codes = {r.unit_id: r.code for r in prepare.file_status(parsed, violations).collect()}
    assert codes == {"good": None, "gap": "bat_cycle_time_gap", "short": "insufficient_history", "wheel": "line_mismatch"}
    assert seen.value == 3 * len(raw)


def test_cells_are_parsed_in_compiled_code(spark):
    """The JVM runs a method of 8,000 bytes or more uncompiled."""
    raw = spark.createDataFrame(battery_text("u", 3), RAW).localCheckpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as shown:
            prepare.parse_readings(spark, raw).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000


def test_doubled_cells_of_known_and_other_channels(spark):
    known, wheel = "bat.capacity_ah", "rw.speed_rpm"
    rows = [("one", 0.0, known), ("one", 0.0, wheel), ("one", 0.0, "x"), ("one", 1.0, known), ("one", 0.0, None)]
    rows += [("known", 0.0, known), ("known", 0.0, wheel), ("known", 0.0, known)]
    rows += [("other", 2.0, "x"), ("other", 2.0, "y"), ("other", 2.0, "x")]
    rows += [("unnamed", 0.0, None), ("unnamed", 0.0, None), ("untimed", None, known), ("untimed", None, known)]
    rows += [(None, 0.0, known), (None, 0.0, known)]
    got = prepare.doubled_cells(spark.createDataFrame(rows, "unit_id string, t double, channel string")).collect()
    places = Counter(rows)
    assert {(r.unit_id, r.t) for r in got} == {k[:2] for k, n in places.items() if n > 1}


def test_channel_sets_stay_in_a_hash_aggregation(spark):
    rows = [("a", 0.0, "x"), ("a", 0.0, "x"), ("a", 0.0, "y"), ("a", 1.0, "y"), ("b", 0.0, None), ("b", None, "x"), (None, 0.0, "z")]
    df = spark.createDataFrame(rows, "unit_id string, t double, channel string")
    have = split.unit_channels(df, ["x", "y"])
    assert {r.unit_id: r.have for r in have.collect()} == {"a": ["x", "y"], "b": ["x"], None: []}
    missing = rules.incomplete_steps(df, prepare.INDEX_AXIS, ["y", "x"])
    assert {r.unit_id: [(e.t, e.missing) for e in r.examples] for r in missing.collect() if r.unit_id == "a"} == {"a": [(1.0, ["x"])]}
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        have.explain()
    assert "HashAggregate" in shown.getvalue() and "ObjectHashAggregate" not in shown.getvalue()
