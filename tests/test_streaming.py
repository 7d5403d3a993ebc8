"""Streaming results equal those of the batch once all input has been read."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from lifespan.operators import binning, segments, windows
from lifespan.operators.segments import Axis
from lifespan.sources import tables as tb
from lifespan.streaming import steps
from lifespan.streaming.bins import stream_bins
from tests.conftest import DATA


def test_stream_matches_batch(spark, tmp_path):
    ev = tb.read(spark, DATA, "events").select(
        F.col("user_id").alias("unit_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value"
    )
    src = str(tmp_path / "src")
    ev.repartitionByRange(4, "ts").write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(src)
    out = stream_bins(stream, ["click", "view"], 86400, "60 days")
    q = out.writeStream.outputMode("update").format("memory").queryName("live_bins").start()
    q.processAllAvailable()
    q.stop()
    live = {(r.unit_id, r.bin_start.timestamp() // 86400): r["click.mean"] for r in spark.sql("select * from live_bins").collect()}
    batch = binning.bin_aggregate(ev.withColumn("t", F.unix_micros("ts") / 1e6), ["click", "view"], 86400.0)
    want = {(r.unit_id, r.bin): r["click.mean"] for r in batch.collect()}
    assert live.keys() == want.keys()
    assert all(live[k] == want[k] or abs(live[k] - want[k]) < 1e-9 for k in want if want[k] is not None)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_available(spark, tmp_path, parts, rules, lateness):
    """The stream over files in the order of ``parts``, a file a trigger."""
    src = tmp_path / "src"
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = steps.stream_steps(stream, rules, lateness)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_steps_of_a_stream_match_the_batch(spark, tmp_path, rocks):
    ev = tb.read(spark, DATA, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 4).alias("unit_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), "value"
    ).where("event_id % 5 = 0")
    end = ev.agg(F.max("ts")).first()[0]
    mark = spark.createDataFrame([("end", end + datetime.timedelta(days=401), -1, 0.0)], ev.schema)
    # files in an order that is not that of time, but within the lateness
    parts = [ev.where(F.col("tie") % 3 == k) for k in (2, 0, 1)] + [mark]
    rules = steps.StepRules(length=6, stride=2, limit=20.0, duration=3600.0)
    got = run_available(spark, tmp_path, parts, rules, "400 days").where("unit_id <> 'end'")
    keyed = ev.withColumn("t", F.unix_micros("ts") / 1e6)
    axis = Axis(("unit_id",), ("t", "tie"))
    numbered = segments.row_numbers(keyed, axis, "step")
    batch = segments.running_min(numbered, axis, "value", "low")
    names = ["unit_id", "ts", "tie", "step", "value", "low"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))
    made = {(r.unit_id, r.window_index): r.x for r in got.where("x is not null").collect()}
    want = windows.sliding_windows(numbered.select("unit_id", "step", "value"), ["value"], 6, 2).collect()
    assert made == {(r.unit_id, r.window_index): [v[0] for v in r.x] for r in want}
    alarms = {r.unit_id: r.first_time.timestamp() for r in got.where("first_time is not null").collect()}
    lasting = binning.sustained_exceedance(keyed, axis, "value", 20.0, 3600.0).where("first_time is not null").collect()
    assert alarms == {r.unit_id: r.first_time for r in lasting}


def test_late_rows_are_dropped(spark, tmp_path, rocks):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "unit_id string, ts timestamp, tie long, value double"
    first = spark.createDataFrame([("u", at(h), h, float(h)) for h in range(10)], schema)
    # hour 3 comes after the watermark (hour 9 less two) has passed it, hour 8 does not
    second = spark.createDataFrame([("u", at(3), 100, -1.0), ("u", at(8), 101, 5.0), ("u", at(50), 102, 1.0)], schema)
    third = spark.createDataFrame([("u", at(200), 103, 0.0)], schema)
    # a trigger drops what is behind the watermark that the one before it began with
    pad = spark.createDataFrame([("pad", at(9), 0, 0.0)], schema)
    got = run_available(spark, tmp_path, [first, pad, second, third], steps.StepRules(3, 1, 1e9, 1.0), "2 hours")
    got = got.where("unit_id = 'u'").orderBy("step").collect()
    assert [r.tie for r in got] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 101, 9, 102]
    assert [r.step for r in got] == list(range(12)) and got[10].low == 0.0
