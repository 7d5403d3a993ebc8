"""Files of many kinds written from a table, one for each group of rows: input for the readers' queries."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame

from lifespan.sources.storage import opened


def _delimited(rows: pd.DataFrame, sep: str = ",") -> bytes:
    return rows.to_csv(index=False, sep=sep).encode()


def _feather(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    feather.write_feather(pa.Table.from_pandas(rows, preserve_index=False), out)
    return out.getvalue()


def _stream(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table, max_chunksize=500)
    return out.getvalue()


def _array(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    np.save(out, rows.to_records(index=False))
    return out.getvalue()


def _arrays(rows: pd.DataFrame, uneven: bool = False) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **{c: rows[c].to_numpy()[: len(rows) + 1 - 2 * (uneven and i)] for i, c in enumerate(rows)})
    return out.getvalue()


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def _tar(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:xz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def table_file(number: int, rows: pd.DataFrame) -> tuple[str, bytes]:
    """Name and bytes of a table by the number of its group; kinds 6 and 7 have faults."""
    makers: list[tuple[str, Callable[[], bytes]]] = [
        ("csv", lambda: _delimited(rows)),
        ("tsv", lambda: _delimited(rows.assign(note="温度"), "\t").decode().encode("gb18030")),
        ("feather", lambda: _feather(rows)),
        ("arrow", lambda: _stream(rows)),
        ("npy", lambda: _array(rows)),
        ("npz", lambda: _arrays(rows)),
        ("npz", lambda: _arrays(rows, uneven=True)),
        ("csv", lambda: _delimited(rows) + b"1\n"),
    ]
    suffix, make = makers[number % 8]
    return f"group{number}.{suffix}", make()


def delimited_file(number: int, rows: pd.DataFrame) -> tuple[str, bytes]:
    """Name and bytes of a delimited table by the number of its group: separator, charset and width differ."""
    rows = rows.drop(columns="nation")
    kind = number % 5
    if kind == 1:
        return f"group{number}.csv", _delimited(rows, ";") + b"1;2;3;4\n"
    if kind == 2:
        return f"group{number}.tsv", b"\xef\xbb\xbf" + _delimited(rows, "\t")
    if kind == 3:
        return f"group{number}.txt", _delimited(rows.assign(name="名" + rows["name"]), ";").decode().encode("gb18030")
    return f"group{number}.csv", _delimited(rows if kind == 0 else rows[["name", "key"]])


def commented_file(number: int, rows: pd.DataFrame) -> tuple[str, bytes]:
    """A delimited table with comment lines before its header and between its rows."""
    header, *lines = _delimited(rows.drop(columns="nation")).decode().splitlines()
    text = ["# exported", header, *(x for i, line in enumerate(lines) for x in (f"# row {i}, group {number}", line))]
    return f"group{number}.csv", "\n".join(text).encode() + b"\n"


def json_file(number: int, rows: pd.DataFrame) -> tuple[str, bytes]:
    """Name and bytes of a JSON array by the number of its group: objects, rows below a header, or two shapes."""
    rows = rows.drop(columns="nation")
    items = [dict(zip(rows.columns, r)) for r in rows.astype(object).itertuples(index=False)]
    if number % 4 == 2:
        items = [list(rows.columns), *(list(x.values()) for x in items)]
    if number % 4 == 3:
        items.append({"key": 1, "other": 2})
    return f"group{number}.json", json.dumps(items).encode()


def text_file(number: int, rows: pd.DataFrame) -> tuple[str, bytes]:
    """All texts of a group, a line between them."""
    return f"group{number}.txt", "\n".join(rows["text"]).encode()


def archive_file(number: int, rows: pd.DataFrame) -> tuple[str, bytes]:
    """Name and bytes of an archive by the number of its group; kinds 3 and 4 have faults, and kind 0 a member with one."""
    half = len(rows) // 2
    a, b = rows[:half], rows[half:]
    kind = number % 5
    if kind == 0:
        return f"group{number}.zip", _zip([("a/one.csv", _delimited(a)), ("two.feather", _feather(b)), ("bad.csv", b"key,nation\n1\n")])
    if kind == 1:
        return f"group{number}.tar.xz", _tar([("one.npy", _array(a)), ("two.npz", _arrays(b))])
    if kind == 2:
        return f"group{number}.csv.gz", gzip.compress(_delimited(rows))
    if kind == 3:
        return f"group{number}.zip", _zip([("one.csv", _delimited(a)), ("../two.csv", _delimited(b))])
    return f"group{number}.tar.xz", _tar([("one.csv", _delimited(a)), ("ONE.csv", _delimited(b))])


def write_each(df: DataFrame, key: str, folder: str, make: Callable[[int, pd.DataFrame], tuple[str, bytes]]) -> DataFrame:
    """Write one file for each value of ``key`` below ``folder``; returns the names.  A task that runs
    again writes the same file again."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
        name, data = make(int(rows[key].iloc[0]), rows)
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
        return pd.DataFrame({"file": [name]})

    return df.groupBy(key).applyInPandas(write, "file string")
