"""Spellings in compatibility form, strict times, whole files and archives."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from lifespan import fixed_values as fv
from lifespan.functions import scalar as sc
from lifespan.operators import joins, mapping, rules
from lifespan.sources import packed, records


def test_labels_and_headers_are_compared_in_compatibility_form(spark):
    labels = ["容量（Ah）", "电池温度(℃)", "ｃａｐａｃｉｔｙ＿ａｈ", None, "other"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    got = {r.i: r.channel for r in mapping.resolve_channels(spark, df, "label").collect()}
    assert got == {0: "bat.capacity_ah", 1: "bat.temp_mean_c", 2: "bat.capacity_ah", 3: None, 4: "unknown:other"}
    heads = spark.createDataFrame([("f", "ｃｙｃｌｅ"), ("f", "容量（Ah）")], "source string, column string")
    found = {r.column: (r.semantic, r.channel) for r in mapping.file_headers(spark, heads).collect()}
    assert found["ｃｙｃｌｅ"][0] == "time" and found["容量（Ah）"][1] == "bat.capacity_ah"


def test_declared_units(spark):
    rows = [("u", "bat.temp_mean_c", "℃"), ("u", "rw.motor_current_a.max", "Ａ"), ("u", "rw.speed_rpm.std", "A"), ("v", "rw.fric_tc.mean", None)]
    expected = joins.dimension(spark, list(fv.CHANNEL_UNITS.items()), "channel string, expected_unit string")
    wrong = rules.unit_mismatch(
        spark.createDataFrame(rows, "unit_id string, channel string, declared_unit string"), expected, joins.alias_table(spark, fv.UNIT_ALIASES, sc.name_key)
    )
    assert [r.details for r in wrong.collect()] == ["rw.speed_rpm.std|A"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_times_are_strict_and_do_not_follow_the_session_zone(spark, zone):
    texts = ["12:30", "T10", "2024-1-1", "2024-01", "12d", "0x1p3", "nan", "2024-01-02", "2024-01-02 03:04", "2024-01-02T03:04:05.5+09:00", "-0", "1e3", None]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = df.select("i", sc.time_kind(F.col("t")).alias("k"), sc.time_order(F.col("t")).alias("o")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.k for r in got] == [None] * 7 + ["iso_naive", "iso_naive", "iso_aware", "numeric", "numeric", None]
    assert [r.o for r in got[:7]] == [None] * 7
    assert [r.o for r in got[7:12]] == [1704153600.0, 1704164640.0, 1704132245.5, 0.0, 1000.0]


def test_first_values_in_order(spark):
    df = spark.createDataFrame([("k", v) for v in ["c", "a一", "bz", "props-2", "props-1", " ", None]], "k string, v string")
    got = mapping.first_values(df, ["k"], "v", 4).orderBy("rank").collect()
    assert [(r.rank, r.text) for r in got] == [(0, "a一"), (1, "bz"), (2, "c"), (3, "props-1")]


def test_files_and_archives_of_any_size_are_read_whole(spark, tmp_path):
    n = 1_200_000
    text = "t,v\n" + "".join(f"{i},{i % 7}\n" for i in range(n))
    assert len(text) > fv.MAX_FILE_BYTES
    (tmp_path / "big.csv.gz").write_bytes(gzip.compress(text.encode(), 1))
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(fv.MAX_FILES + 1):
            z.writestr(f"m{i}.csv", f"t,v\n{i},1\n")
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    with zipfile.ZipFile(tmp_path / "same.zip", "w") as z:
        z.writestr("Ａ.csv", "t,v\n")
        z.writestr("a.csv", "t,v\n")
    cells, issues = packed.read_packed(spark, str(tmp_path), str(tmp_path) + "-read")
    assert {r.source.rsplit("/", 1)[1]: r.code for r in issues.collect()} == {"none.zip": "zip_member_count", "same.zip": "duplicate_zip_member"}
    counted = cells.where("column = 't'").groupBy("source").count().collect()
    assert {r["source"].rsplit("/", 1)[1]: r["count"] for r in counted} == {"big.csv.gz": n, "many.zip": fv.MAX_FILES + 1}
    limits = packed.Limits(members=fv.MAX_FILES, member_bytes=10)
    limited = packed.read_packed(spark, str(tmp_path), str(tmp_path) + "-limited", limits)[1]
    assert {"too_many_files", "duplicate_zip_member"} <= {r.code for r in limited.collect()}
    assert "expanded_file_too_large" in packed.Limits(member_bytes=2).codes(1, 3, 3)


def test_json_files(spark, tmp_path):
    cases = {
        "lines.jsonl": '{"t": 0, "v": 1}\n\n{"v": 2, "t": 1}\n',
        "more.json": '[{"t": 0, "v": 1}, {"t": 1, "v": 2, "w": 3}]',
        "twice.json": '[{"t": 0, "v": 1, "v": 2}]',
        "rows.json": '[["t", "v"], [0, 1], [1, 2]]',
        "short.json": '[["t", "v"], [0]]',
        "none.json": "[]",
        "object.json": "{}",
        "bad.jsonl": "{",
        "list.jsonl": "[1]",
    }
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    cells, issues = packed.read_packed(spark, str(tmp_path), str(tmp_path) + "-read")
    last = F.element_at(F.split("source", "/"), -1)
    out = cells.withColumn("file", last).toPandas()
    for name in ("lines.jsonl", "rows.json"):
        assert out[out.file == name].sort_values(["column", "row_number"])["text"].tolist() == ["0", "1", "1", "2"]
    assert {r.file: r.code for r in issues.withColumn("file", last).collect()} == {
        "more.json": "json_record_shape", "twice.json": "duplicate_json_key", "short.json": "row_column_count", "none.json": "no_observations",
        "object.json": "json_layout_required", "bad.jsonl": "invalid_json_line", "list.jsonl": "json_layout_required",
    }


def test_equal_records_stay_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t": 0, "v": 1}\n{"t": 0, "v": 1}\n')
    cells, issues = records.read_json_records(spark, str(tmp_path))
    assert cells.count() == 4 and cells.select("record_id").distinct().count() == 2 and issues.isEmpty()


def test_negative_labels_go_and_unknown_ones_stay(spark):
    from lifespan.operators import windows

    df = spark.createDataFrame([(0, 1.0), (1, -0.5), (2, None), (3, float("nan")), (4, 0.0)], "i int, y double")
    assert sorted(r.i for r in windows.drop_negative(df, "y").collect()) == [0, 2, 3, 4]


def test_empty_holdout_list_is_an_error(spark):
    used = spark.createDataFrame([(1,), (2,)], "unit_id int")
    assert [r.unit_id for r in rules.holdout_leaks(used, used.where("unit_id = 2")).collect()] == [2]
    with pytest.raises(ValueError, match="hold-out"):
        rules.holdout_leaks(used, used.where("unit_id > 2"))


def test_wide_sources_of_any_number_of_columns(spark):
    meanings = [("time", "time", None)] + [(f"channel{i}", None, f"channel{i}") for i in range(40)]
    data = [("s", key, semantic, None, channel, key) for key, semantic, channel in meanings]
    headers = spark.createDataFrame(data, "source string, header_key string, semantic string, metadata string, channel string, column string")
    refused = "telemetry_table_columns_required"
    assert refused not in mapping.detect_layout(headers).first().asDict().values()
    assert refused in mapping.detect_layout(headers, fv.MAX_COLUMNS).first().asDict().values()
