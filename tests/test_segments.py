"""Segment-wise ordered operators against pandas, with segments far smaller than the units."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lifespan.operators import binning, isotonic, joins, split, windows
from lifespan.operators import segments as sg
from lifespan.operators.segments import Axis

NARROW = Axis(("unit_id",), ("t", "row"), 7.0)
WHOLE = Axis(("unit_id",), ("t", "row"))
both_axes = pytest.mark.parametrize("axis", [NARROW, WHOLE, "fitted"])


def resolve(axis, df):
    return Axis.fit(df, ("unit_id",), ("t", "row"), rows=30) if axis == "fitted" else axis


@pytest.fixture(scope="module")
def skewed():
    """One unit holds most rows; times repeat and leave whole segments empty."""
    rng = np.random.default_rng(3)
    parts = []
    for unit, n in (("hot", 600), ("a", 40), ("b", 3), ("c", 1)):
        t = np.sort(rng.integers(0, 400, n)).astype(float)
        value = rng.normal(size=n).round(3)
        parts.append(pd.DataFrame({"unit_id": unit, "t": t, "row": np.arange(n), "value": value}))
    df = pd.concat(parts, ignore_index=True)
    df["maybe"] = df["value"].where(df["value"] > 0.8)
    return df


def as_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "unit_id string, t double, row long, value double, maybe double")


def ordered(pdf):
    return pdf.sort_values(["unit_id", "t", "row"]).reset_index(drop=True)


@both_axes
def test_row_numbers(spark, skewed, axis):
    axis = resolve(axis, as_spark(spark, skewed))
    out = ordered(sg.row_numbers(as_spark(spark, skewed), axis, "step", "n").toPandas())
    want = ordered(skewed)
    assert (out["step"] == want.groupby("unit_id").cumcount()).all()
    assert (out["n"] == want.groupby("unit_id")["row"].transform("size")).all()


@both_axes
def test_previous_and_next(spark, skewed, axis):
    axis = resolve(axis, as_spark(spark, skewed))
    df = as_spark(spark, skewed)
    out = ordered(sg.next_row(sg.previous_row(df, axis, ["value"]), axis, ["value"]).toPandas())
    want = ordered(skewed)
    for name, shift in (("prev_value", 1), ("next_value", -1)):
        expected = want.groupby("unit_id")["value"].shift(shift)
        assert out[name].fillna(-99).tolist() == expected.fillna(-99).tolist()


@both_axes
def test_running_min_and_sum(spark, skewed, axis):
    axis = resolve(axis, as_spark(spark, skewed))
    df = as_spark(spark, skewed)
    out = ordered(sg.running_sum(sg.running_min(df, axis, "value", "low"), axis, "value", "total").toPandas())
    want = ordered(skewed).groupby("unit_id")["value"]
    assert out["low"].tolist() == want.cummin().tolist()
    assert np.allclose(out["total"], want.cumsum())


@both_axes
def test_last_known(spark, skewed, axis):
    axis = resolve(axis, as_spark(spark, skewed))
    out = ordered(sg.last_known(as_spark(spark, skewed), axis, "maybe", "seen").toPandas())
    expected = ordered(skewed).groupby("unit_id")["maybe"].ffill()
    assert out["seen"].fillna(-99).tolist() == expected.fillna(-99).tolist()


def test_fitted_axis_cuts_only_large_units(spark, skewed):
    df = as_spark(spark, skewed)
    axis = Axis.fit(df, ("unit_id",), ("t", "row"), rows=30)
    sizes = axis.segmented(df).groupBy("unit_id", sg.SEG).count().toPandas().set_index("unit_id")
    assert axis.large.count() == 2 and sizes.loc["hot", "count"].max() <= 30
    assert (sizes.loc[["b", "c"], sg.SEG] == 0).all()
    assert Axis.fit(df, ("unit_id",), ("t", "row"), rows=1000).whole_units


@pytest.mark.parametrize("shape", ["burst", "one second", "even"])
def test_cuts_follow_ranks_not_times(spark, shape):
    """Rows of a segment stay near what is asked for, in a burst and inside one second too."""
    n = 40_000
    t = {"burst": "if(id < 39000, 1e6 + id / 1e6, id * 100.0)", "one second": "5.0", "even": "id * 3.0"}[shape]
    df = spark.range(n).selectExpr("'u' as unit_id", f"double({t}) as t", "id as row", "double(id % 7) as value", "double(null) as maybe")
    axis = Axis.fit(df, ("unit_id",), ("t", "row"), rows=200)
    sizes = [r["count"] for r in axis.segmented(df).groupBy("unit_id", sg.SEG).count().collect()]
    assert len(sizes) <= 2 * n / 200 and max(sizes) <= 2 * 200 and sum(sizes) == n
    numbered = sg.row_numbers(df, axis, "step").toPandas().sort_values(["t", "row"])
    assert numbered["step"].tolist() == list(range(n))


def test_cuts_with_nulls_and_equal_positions(spark):
    rows = [("u", None if i % 3 == 0 else float(i % 5), None if i % 7 == 0 else i) for i in range(300)] + [("u", 2.0, 9)] * 100
    df = spark.createDataFrame(rows, "unit_id string, t double, row long")
    axis = Axis.fit(df, ("unit_id",), ("t", "row"), rows=20)
    out = sg.row_numbers(df, axis, "step", "n").toPandas()
    assert sorted(out["step"]) == list(range(400)) and (out["n"] == 400).all()
    by_step = out.sort_values("step")
    assert by_step["t"].isna().tolist() == [True] * 100 + [False] * 300 and by_step["t"].dropna().is_monotonic_increasing


@pytest.mark.parametrize("whole", [False, True])
def test_ranked_values_cover_all_positions(spark, skewed, whole):
    pdf = skewed.assign(value=(skewed["value"] * 4).round())
    counted = as_spark(spark, pdf).groupBy("unit_id", "value").agg(F.count(F.lit(1)).alias("n"))
    out = sg.ranked_values(counted, ["unit_id"], "value", slots=8, whole=whole).toPandas()
    for unit, rows in out.groupby("unit_id"):
        values = np.sort(pdf.loc[pdf.unit_id == unit, "value"].to_numpy())
        for r in rows.itertuples():
            assert (values[r.rank_from : r.rank_to + 1] == r.value).all()
        assert rows["n"].sum() == len(values)


@pytest.mark.parametrize("rows", [10, 100_000])
def test_quantile_edges_match_order_statistics(spark, rows, monkeypatch):
    monkeypatch.setattr(windows, "SEGMENT_ROWS", rows)
    rng = np.random.default_rng(5)
    values = rng.normal(size=400).round(2)
    pdf = pd.DataFrame({"feature": 0, "value": values})
    out = windows.quantile_edges(spark.createDataFrame(pdf), 16).toPandas().sort_values("edge_index")
    expected = np.percentile(values, np.linspace(0, 100, 17)[1:-1], method="midpoint")
    assert np.allclose(out["edge"], expected)


@both_axes
def test_unit_values_and_spread_join(spark, skewed, axis):
    axis = resolve(axis, as_spark(spark, skewed))
    df = as_spark(spark, skewed)
    out = ordered(sg.unit_values(df, axis, {"top": (F.max("value"), F.max), "n": (F.count("value"), F.sum)}).toPandas())
    want = ordered(skewed).groupby("unit_id")["value"]
    assert out["top"].tolist() == want.transform("max").tolist() and out["n"].tolist() == want.transform("size").tolist()
    units = spark.createDataFrame([("hot", 1), ("b", 2)], "unit_id string, tag int")
    for rows in (50, 100_000):
        assert sg.spread_join(df, units, ["unit_id"], "left_anti", rows).count() == 41
        assert sg.spread_join(df, units, ["unit_id"], "inner", rows).count() == 603
        assert sg.spread_join(df, units, ["unit_id"], "left", rows).count() == len(skewed)
    nameless = df.withColumn("unit_id", F.when(F.col("unit_id") != "hot", F.col("unit_id")))
    out = sg.spread_join(nameless, units, ["unit_id"], "left", 50).toPandas()
    assert len(out) == len(skewed) and out["tag"].notna().sum() == 3 and out.columns[0] == "unit_id"
    assert sg.spread_join(nameless, units, ["unit_id"], "left_anti", 50).count() == 641


def brute_isotonic(values):
    n = len(values)
    means = lambda a, b: np.mean(values[a : b + 1])
    return [min(max(means(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps"])
@pytest.mark.parametrize("slice_rows", [4, 1000])
def test_isotonic_in_slices(spark, shape, slice_rows):
    rng = np.random.default_rng(11)
    n = 45
    base = {
        "noise": rng.normal(size=n),
        "rising": np.arange(n, dtype=float),
        "falling": -np.arange(n, dtype=float),
        "steps": np.repeat([3.0, 5.0, 1.0, 4.0, 0.0], 9) + rng.normal(size=n) * 0.1,
    }[shape]
    pdf = pd.concat(
        [
            pd.DataFrame({"unit_id": "hot", "step": range(n), "value": base}),
            pd.DataFrame({"unit_id": "small", "step": range(3), "value": base[:3]}),
        ]
    )
    axis = Axis(("unit_id",), ("step",), float(slice_rows))
    out = isotonic.isotonic_nonincreasing(spark.createDataFrame(pdf), axis, "value", "level", slice_rows).toPandas()
    for unit, rows in out.sort_values("step").groupby("unit_id"):
        expected = brute_isotonic(pdf.loc[pdf.unit_id == unit, "value"].to_numpy())
        assert np.allclose(rows["level"], expected), unit
        assert (np.diff(rows["level"]) <= 1e-12).all()


@pytest.mark.parametrize("length,stride", [(10, 3), (12, 4), (5, 1), (3, 7), (10, 10)])
@pytest.mark.parametrize("axis", [None, Axis(("unit_id",), ("step",))])
def test_windows_across_blocks(spark, length, stride, axis):
    n = 103
    pdf = pd.DataFrame({"unit_id": "u", "step": range(n), "v": np.arange(n) * 1.5, "t": np.arange(n) * 10.0})
    df = spark.createDataFrame(pdf).repartition(5)
    out = windows.sliding_windows(df, ["v"], length, stride, carry=["t"], block=23, axis=axis)
    out = out.toPandas().sort_values("window_index")
    assert out["window_index"].tolist() == list(range((n - length) // stride + 1))
    for r in out.itertuples():
        start = r.window_index * stride
        assert [row[0] for row in r.x] == [1.5 * (start + i) for i in range(length)]
        assert r.end_step == start + length - 1 and r.t == 10.0 * r.end_step


@pytest.mark.parametrize("rows,length,stride,count", [(60, 60, 5, 1), (90, 60, 5, 7), (30, 30, 1, 1), (40, 30, 1, 11), (59, 60, 5, 0)])
def test_window_counts(spark, rows, length, stride, count):
    steps = spark.range(rows).selectExpr("'u' as unit_id", "id as step", "double(id) as v")
    assert windows.sliding_windows(steps, ["v"], length, stride).count() == count
    assert steps.agg(windows.window_count(F.count(F.lit(1)), length, stride)).first()[0] == count


def test_trend_targets_across_blocks(spark):
    steps = spark.range(23).selectExpr("'u' as unit_id", "id as step", "double(id) as y")
    out = {r.step: r.y_trend for r in windows.trend_targets(steps, "y", 4, block=5).collect()}
    assert out[0] == [1.0, 2.0, 3.0, 4.0]
    assert out[20] == [21.0, 22.0, None, None]
    assert len(out) == 23


@pytest.mark.parametrize("axis", [Axis(("unit_id",), ("t",), 2.0), Axis(("unit_id",), ("t",))])
def test_asof_ties_take_last(spark, axis):
    left = spark.createDataFrame([("u", 1, 5.0), ("u", 2, 20.0), ("v", 3, 1.0)], "unit_id string, row_number long, t double")
    right = spark.createDataFrame(
        [("u", 10, 5.0, 1.0), ("u", 11, 5.0, 2.0), ("u", 12, 6.0, 3.0)], "unit_id string, row_number long, pt double, p double"
    )
    out = {r.row_number: (r.matched_t, r.p) for r in joins.asof_join(left, right, "t", "pt", ["p"], axis).collect()}
    assert out == {1: (5.0, 2.0), 2: (6.0, 3.0), 3: (None, None)}


@pytest.mark.parametrize("axis", [NARROW, WHOLE])
def test_first_crossing_and_sustained(spark, axis):
    pdf = pd.DataFrame({"unit_id": "u", "t": np.arange(40.0), "row": range(40), "value": [0.0] * 10 + [4.0] * 2 + [0.0] * 5 + [6.0] * 23, "maybe": None})
    df = as_spark(spark, pdf)
    assert binning.first_crossing(df, axis, "value", 1.0).first().crossing_time == pytest.approx(9.25)
    assert binning.sustained_exceedance(df, axis, "value", 3.0, 5.0).first().first_time == 17.0


def test_split_clamps_and_is_stable(spark):
    units = spark.range(200).selectExpr(
        "string(id) as unit_id", "case when id < 150 then 'hot' when id < 152 then 'two' when id = 152 then 'one' else 'rest' end as cell"
    )
    held = spark.createDataFrame([("0",)], "unit_id string")
    out = split.cell_tail_split(units, "cell", 0.2, 0, held).toPandas()
    counts = out.groupby(["cell", "split"]).size()
    assert counts["hot", "val"] == 29 and counts["hot", "holdout"] == 1
    assert counts["two", "val"] == 1 and counts["two", "train"] == 1
    assert counts["one", "train"] == 1 and ("one", "val") not in counts
    again = split.cell_tail_split(units.repartition(5), "cell", 0.2, 0, held).toPandas()
    key = ["unit_id", "cell", "split"]
    assert out.sort_values("unit_id")[key].values.tolist() == again.sort_values("unit_id")[key].values.tolist()
