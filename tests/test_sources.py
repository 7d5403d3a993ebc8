"""File formats, archives and sinks on small fixtures."""

import gzip
import io
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from lifespan.operators import ledger
from lifespan.operators.segments import Axis
from lifespan.sources import delimited, files, packed, records, runs


def test_delimited(spark, tmp_path):
    files_of = {
        "a.csv": "\ufefftime_s;channel;value\n0;x;1\n1;x;2\n".encode(),
        "b c+.csv": 'time_s,value\n0,"1,5"\n1,"say ""hi"""\n\n'.encode(),
        "g.tsv": "时间\t值\n0\t中\n1\t\n".encode("gb18030"),
        "z.tsv.gz": gzip.compress("t\tv\n0\té\n".encode()), "y.csv.gz": gzip.compress("时;v\n0;中\n".encode("gb18030")), "x.csv.gz": b"no gzip",
        "bad.csv": b"a,b\n1,2\n3\n4,5,6\n7,8\n",
        "late.csv": b"a,b\n" + b"1,2\n" * 30_000 + "3,中\n".encode("gb18030"),
        "empty.csv": b" \n", "one.csv": b"alone\n1\n", "twice.csv": b"a,a\n1,2\n", "odd.csv": b"a,b\n\xff\xff,1\n",
    }
    (tmp_path / "in").mkdir()
    for name, data in files_of.items():
        (tmp_path / "in" / name).write_bytes(data)
    cells, issues = delimited.read_delimited_files(spark, str(tmp_path / "in"), str(tmp_path / "utf8"))
    found = sorted((r.file, r.column, r.text) for r in names_of(cells.where("source not like '%late%'")).collect())
    assert found == sorted([
        ("a.csv", "time_s", "0"), ("a.csv", "channel", "x"), ("a.csv", "value", "1"), ("a.csv", "time_s", "1"), ("a.csv", "channel", "x"), ("a.csv", "value", "2"),
        ("b c+.csv", "time_s", "0"), ("b c+.csv", "value", "1,5"), ("b c+.csv", "time_s", "1"), ("b c+.csv", "value", 'say "hi"'),
        ("g.tsv", "时间", "0"), ("g.tsv", "值", "中"), ("g.tsv", "时间", "1"), ("g.tsv", "值", ""),
        ("z.tsv.gz", "t", "0"), ("z.tsv.gz", "v", "é"), ("y.csv.gz", "时", "0"), ("y.csv.gz", "v", "中"),
        ("bad.csv", "a", "1"), ("bad.csv", "b", "2"), ("bad.csv", "a", "7"), ("bad.csv", "b", "8"),
    ])
    assert cells.where("source like '%late%'").count() == 60_000
    codes = sorted((r.file, r.code, r.line if r.file == "bad.csv" else None) for r in names_of(issues).collect())
    assert codes == [
        ("bad.csv", "row_column_count", "3"), ("bad.csv", "row_column_count", "4,5,6"), ("empty.csv", "empty_file", None), ("late.csv", "unsupported_encoding", None),
        ("odd.csv", "unsupported_encoding", None), ("one.csv", "delimiter_unknown", None), ("twice.csv", "ambiguous_header", None),
        ("x.csv.gz", "invalid_file", None),
    ]
    one = delimited.dialects(spark, str(tmp_path / "in" / "*.tsv"), str(tmp_path / "utf8")).first()
    assert (one.charset, one.separator, one.header) == ("gb18030", "\t", ["时间", "值"])


def test_commented_and_prediction_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# note\na,b\n# more\n1,2\n")
    assert [r.asDict() for r in delimited.read_commented_csv(spark, str(tmp_path / "c.csv")).collect()] == [{"a": "1", "b": "2"}]
    (tmp_path / "p.csv").write_text(
        "window_id,unit_id,t_end,route_id,prediction,rul_unit,truth\n"
        "0,BAT_S222,1,R,3.14159,cycles,3\n1,u,2,R,nan,cycles,3\n2,,3,R,1,cycles,1\n3,u,4,X,1,cycles,1\n"
    )
    rows = delimited.read_prediction_csv(spark, str(tmp_path / "p.csv"), "R")
    good = rows.where("valid").collect()
    assert len(good) == 1 and good[0].unit_id == "BAT_N222" and good[0].p50 == 3.1416
    assert delimited.prediction_counts(rows).first().invalid_rows == 3


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"t": 0, "v": 1.5}\n\n{"v": 2, "t": 1}\n')
    (tmp_path / "shape.jsonl").write_text('{"t": 0, "v": 1}\n{"t": 1}\n')
    (tmp_path / "dup.jsonl").write_text('{"t": 0, "t": 1, "v": 2}\n')
    cells, issues = records.read_json_records(spark, str(tmp_path / "*.jsonl"))
    assert {r.source.rsplit("/", 1)[1]: r.code for r in issues.collect()} == {"shape.jsonl": "json_record_shape", "dup.jsonl": "duplicate_json_key"}
    assert sorted((r.column, r.text) for r in cells.collect()) == [("t", "0"), ("t", "1"), ("v", "1.5"), ("v", "2")]
    (tmp_path / "rows.json").write_text('[["t", "v"], [0, 1.5], [1, 2.5]]')
    (tmp_path / "objects.json").write_text('[{"t": 0, "v": 1.5},\n {"t": 1, "v": 2.5}]')
    for name in ("rows", "objects"):
        cells, issues = records.read_json_records(spark, str(tmp_path / f"{name}.json"), lines=False)
        assert issues.count() == 0
        assert sorted((r.column, r.text) for r in cells.collect()) == [("t", "0"), ("t", "1"), ("v", "1.5"), ("v", "2.5")]


@pytest.fixture()
def binaries(tmp_path):
    table = pa.table({"cycle": [0, 1], "value": [1.5, 2.5]})
    feather.write_feather(table, str(tmp_path / "a.feather"))
    with pa.ipc.new_stream(str(tmp_path / "s.arrow"), table.schema) as w:
        w.write_table(table)
    np.savez(tmp_path / "b.npz", cycle=np.arange(2), value=np.array([1.5, 2.5]))
    np.save(tmp_path / "c.npy", np.array([(0, 1.5), (1, 2.5)], dtype=[("cycle", int), ("value", float)]))
    np.save(tmp_path / "o.npy", np.array([{}, {}], dtype=object))
    np.savez(tmp_path / "len.npz", cycle=np.arange(3), value=np.arange(2))
    np.savez(tmp_path / "dim.npz", cycle=np.zeros((2, 2)), value=np.arange(2))
    (tmp_path / "g.csv").write_bytes("cycle;value\n0;1.5\n1;2.5\n".encode("gb18030"))
    (tmp_path / "w.tsv").write_text("cycle\tvalue\n0\n")
    (tmp_path / "j.json").write_text('[{"cycle": 0, "value": 1.5}, {"value": 2.5, "cycle": 1}]')
    return tmp_path


def names_of(rows, column="source"):
    return rows.withColumn("file", F.element_at(F.split(column, "/"), -1))


def read_all(spark, path, **limits):
    cells, issues = packed.read_packed(spark, str(path), str(path) + "-read", packed.Limits(**limits))
    return names_of(cells).toPandas(), {(r.file, r.member): r.code for r in names_of(issues).collect()}


@pytest.mark.parametrize("rows", [1, 1 << 20])
def test_binary_tables(spark, binaries, rows):
    out, codes = read_all(spark, binaries, rows=rows)
    for name in ("a.feather", "s.arrow", "b.npz", "c.npy", "g.csv", "j.json"):
        cells = out[(out.file == name)].sort_values(["column", "row_number"])
        assert cells["text"].tolist() == ["0", "1", "1.5", "2.5"] and cells["row_number"].tolist() == [0, 1, 0, 1], name
    assert codes == {
        ("o.npy", None): "unsafe_object_array", ("len.npz", None): "binary_column_length", ("dim.npz", None): "binary_layout_required",
        ("w.tsv", None): "row_column_count",
    }
    assert set(out.file) == {"a.feather", "s.arrow", "b.npz", "c.npy", "g.csv", "j.json"}


def test_arrays_are_read_by_ranges(spark, tmp_path):
    n = 50_000
    np.save(tmp_path / "big.npy", np.array([(i, i / 2) for i in range(n)], dtype=[("t", "<i8"), ("v", "<f4")]))
    reader = packed.PackedReader(str(tmp_path), packed.Limits(rows=7000))
    parts = reader.partitions()
    assert [(p.first, p.count) for p in parts] == [(i, min(7000, n - i)) for i in range(0, n, 7000)]
    out, codes = read_all(spark, tmp_path, rows=7000)
    v = out[out.column == "v"].sort_values("row_number")
    assert not codes and v["row_number"].tolist() == list(range(n)) and v["text"].astype(float).tolist() == [i / 2 for i in range(n)]
    # a file that ends early has a code and no cells
    data = (tmp_path / "big.npy").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "short.npy").write_bytes(data[:-5])
    out, codes = read_all(spark, tmp_path / "cut", rows=7000)
    assert codes == {("short.npy", None): "invalid_file"} and out.empty


def test_charset_of_lines():
    lines = ["a;b\n".encode(), "é;1\n".encode(), "温;2\n".encode()]
    assert list(packed.text_lines(lines)) == ["a;b\n", "é;1\n", "温;2\n"]
    assert list(packed.text_lines([b"\xef\xbb\xbfa\n", "温\n".encode("gb18030")])) == ["a\n", "温\n"]
    with pytest.raises(packed.Refused, match="unsupported_encoding"):
        list(packed.text_lines(["é\n".encode(), "温\n".encode("gb18030")]))


def test_size_limit(spark, binaries):
    assert files.read_small_files(spark, str(binaries / "*"), max_bytes=10).count() == 0
    assert files.oversized_files(spark, str(binaries / "*"), max_bytes=10).count() == 10


def test_archives(spark, tmp_path):
    def zipped(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in members:
                z.writestr(member, text)

    zipped("good.zip", [("a.csv", "t,v\n0,1\n"), ("d/b.csv", "t,v\n0,2\n")])
    zipped("up.zip", [("../a.csv", "x")])
    zipped("nested.zip", [("a.zip", "x")])
    zipped("twice.zip", [("a.csv", "x"), ("A.csv", "y")])
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x.csv")
        info.size = 3
        t.addfile(info, io.BytesIO(b"a,b"))
    with tarfile.open(tmp_path / "link.tar", "w") as t:
        info = tarfile.TarInfo("l.csv")
        info.type, info.linkname = tarfile.SYMTYPE, "/etc/hosts"
        t.addfile(info)
    (tmp_path / "one.csv.gz").write_bytes(gzip.compress(b"t,v\n"))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(b"t,v\n" + b"0,1\n" * 5000)[:-20])
    with tarfile.open(tmp_path / "two.tar.xz", "w:xz") as t:
        for name, text in (("a.csv", b"t,v\n0,5\n"), ("b/c.json", b'[{"t": 1, "v": 6}]'), ("b/d.csv", b"t,v\n7\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    (tmp_path / "cut.tar.xz").write_bytes((tmp_path / "two.tar.xz").read_bytes()[:100])
    out, codes = read_all(spark, tmp_path)
    assert codes == {
        ("up.zip", None): "unsafe_zip_member", ("nested.zip", None): "archive_member_unsupported", ("twice.zip", None): "duplicate_zip_member",
        ("link.tar", None): "unsafe_tar_member", ("broken.zip", None): "invalid_archive", ("cut.csv.gz", "cut.csv"): "invalid_file",
        ("two.tar.xz", "b/d.csv"): "row_column_count", ("cut.tar.xz", None): "invalid_archive",
    }
    found = sorted((r.file, r.member, r.row_number, r.column, r.text) for r in out.itertuples())
    assert found == [
        ("good.zip", "a.csv", 0, "t", "0"), ("good.zip", "a.csv", 0, "v", "1"), ("good.zip", "d/b.csv", 0, "t", "0"), ("good.zip", "d/b.csv", 0, "v", "2"),
        ("two.tar.xz", "a.csv", 0, "t", "0"), ("two.tar.xz", "a.csv", 0, "v", "5"), ("two.tar.xz", "b/c.json", 0, "t", "1"), ("two.tar.xz", "b/c.json", 0, "v", "6"),
    ]


def test_nothing_is_unpacked_twice(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(6):
            z.writestr(f"m{i}.csv", f"t,v\n{i},1\n")
    reader = packed.PackedReader(str(tmp_path), packed.Limits(size=20))
    parts = reader.partitions()
    assert sorted(n for p in parts for n in p.names) == [f"m{i}.csv" for i in range(6)] and len(parts) > 1
    opened = []
    original = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(name) or original(self, name, *a, **k))
    cells = [b for p in parts for b in reader.read(p)]
    assert sorted(opened) == [f"m{i}.csv" for i in range(6)] and sum(b.num_rows for b in cells) == 12


def test_file_kinds(spark):
    names = ["a.CSV", "b.jsonl", "c.parquet", "d.npz", "e.tar.gz", "f.pkl"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(files.file_kind(F.col("p"))).collect()] == ["text", "json", "columnar", "arrays", "archive", "unsupported_file_type"]


def test_unit_dataset_round_trip(spark, tmp_path):
    df = spark.range(3000).selectExpr("concat('u', id % 300) as unit_id", "double(id) as t", "double(id) / 7 as v")
    df = df.unionByName(spark.range(400).selectExpr("cast(null as string) as unit_id", "double(id) as t", "1.0 as v"))
    path = str(tmp_path / "out" / "units")
    for axis in (Axis(("unit_id",), ("t",)), Axis.fit(df, ("unit_id",), ("t",), rows=50)):
        files.write_unit_dataset(df, path, axis, buckets=8)
        back = files.read_unit_dataset(spark, path).select("unit_id", "t", "v")
        assert ledger.stored_differences(back, df).count() == 0
        # one version, files by bucket and segment whatever the number of units
        assert len(list((tmp_path / "out" / "units" / "data").iterdir())) == 1
        assert len(list((tmp_path / "out" / "units").rglob("*.parquet"))) <= 8 + 8 * (not axis.whole_units)
    one = files.read_unit_dataset(spark, path, [("u7",)])
    assert one.count() == 10 and len(one.inputFiles()) <= 8
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan.split("PartitionFilters")[1][:80]
    assert files.read_unit_dataset(spark, path, [(None,)]).count() == 400 and files.read_unit_dataset(spark, path, []).count() == 0
    files.write_unit_dataset(df.where("unit_id <> 'u2'"), path, Axis(("unit_id",), ("t",)))
    assert files.read_unit_dataset(spark, path, [("u2",)]).count() == 0 and files.read_unit_dataset(spark, path).count() == 2990
    with pytest.raises(PermissionError):
        files.write_unit_dataset(df, str(tmp_path / "raw" / "x"), Axis(("unit_id",), ("t",), 10.0), [str(tmp_path / "raw")])
    with pytest.raises(FileNotFoundError):
        files.read_unit_dataset(spark, str(tmp_path / "nothing"))


def test_manifest_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    found = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame(
        [("a.bin", 3, sha(b"one")), ("b.bin", 3, sha(b"xxx")), ("c.bin", 1, sha(b""))], "path string, expected_bytes long, expected_sha256 string"
    )
    states = {r.path: r.state for r in ledger.manifest_audit(found, manifest).collect()}
    assert states == {"a.bin": "ok", "b.bin": "changed", "c.bin": "missing"}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "a int, b string")
    cols = [F.col("a"), F.col("b")]
    one = ledger.fingerprint(df, cols).first().fingerprint
    assert ledger.fingerprint(df.orderBy(F.desc("a")), cols).first().fingerprint == one
    assert ledger.fingerprint(df.na.fill("", ["b"]), cols).first().fingerprint != one


# -- runs ----------------------------------------------------------------------


def predicted(spark, n, shift):
    return spark.range(n).selectExpr(
        "id as window_id", "concat('u', id % 3) as unit_id", "double(id) as t_end", "'R' as route_id", f"double(id) + {shift} as prediction",
        "'cycles' as rul_unit", "if(id % 4 = 0, null, double(id)) as truth",
    )


def test_runs_are_replaced_whole(spark, tmp_path):
    path, source = str(tmp_path / "runs"), spark.range(7)
    runs.write_run(spark, path, "a", predicted(spark, 40, 1.0).repartition(5), "battery", "validation", "R", "cycles", {"x": source})
    first = runs.read_ledger(spark, path).first()
    runs.write_run(spark, path, "a", predicted(spark, 20, 2.0).repartition(3), "battery", "validation", "R", "cycles", {"x": source})
    runs.write_run(spark, path, "b", predicted(spark, 0, 2.0), "battery", "holdout", "R", "cycles", {"x": source.limit(0)})
    receipts = {r.run_id: r for r in runs.read_ledger(spark, path).collect()}
    assert set(receipts) == {"a", "b"} and receipts["a"].n_windows == 20 and receipts["b"].n_windows == 0 and receipts["b"].metrics is None
    a = receipts["a"]
    assert (a.metrics.rmse, a.metrics.mae, a.metrics.bias, a.metrics.n) == (2.0, 2.0, 2.0, 15)
    assert a.inputs == first.inputs and a.inputs[0].n_rows == 7
    stored = {p.name: p for p in (tmp_path / "runs" / "runs" / "a").glob("part-*")}
    assert {f.name for f in a.files} == set(stored)
    import hashlib

    assert all(hashlib.sha256(stored[f.name].read_bytes()).hexdigest() == f.sha256 and stored[f.name].stat().st_size == f.bytes for f in a.files)
    rows = runs.read_run(spark, path, "a", "R").collect()
    assert len(rows) == 20 and sum(r.valid for r in rows) == 15
    with pytest.raises(ValueError, match="no run"):
        runs.read_run(spark, path, "c", "R")


def test_a_run_that_fails_leaves_no_receipt(spark, tmp_path):
    path = str(tmp_path / "runs")
    bad = predicted(spark, 40, 1.0).repartition(4).withColumn("prediction", F.expr("if(window_id = 17, raise_error('x'), prediction)"))
    with pytest.raises(Exception):
        runs.write_run(spark, path, "a", bad, "battery", "validation", "R", "cycles", {})
    assert not list((tmp_path / "runs").glob("ledger/*"))
    with pytest.raises(ValueError, match="run id"):
        runs.write_run(spark, path, "../a", predicted(spark, 1, 0.0), "battery", "validation", "R", "cycles", {})
