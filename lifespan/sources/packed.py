"""Archives and array files as a data source: tasks read members, row ranges or record batches.

Planning looks at what a file says of itself (the directory of a zip, the head of an array), never
at its data.  A zip gives tasks of members, an array tasks of row ranges read by their bytes; a tar,
which has no directory, is one task that walks through it once, and so is any other file.  Members
are decoded as they are unpacked, a chunk of rows at a time.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import lzma
import posixpath
import tarfile
import unicodedata
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lifespan import fixed_values as fv
from lifespan.config import BROADCAST_ROWS
from lifespan.sources.storage import listed, opened

CELLS = pa.schema(
    [("source", pa.string()), ("member", pa.string()), ("row_number", pa.int64()), ("column", pa.string()), ("text", pa.string()), ("code", pa.string())]
)
CELLS_DDL = "source string, member string, row_number long, column string, text string, code string"
#: Rows that are decoded before they are handed on.
CHUNK = 8_192
DATA_SUFFIXES = (*fv.TEXT_SUFFIXES, *fv.JSON_SUFFIXES, *fv.COLUMNAR_SUFFIXES, *fv.ARRAY_SUFFIXES, *fv.OTHER_DATA_SUFFIXES)


class Refused(ValueError):
    """A file or member that is not read, with its code."""


Columns = dict[str, list]


# -- decoding ------------------------------------------------------------------------------


def text_lines(stream: Iterable[bytes]) -> Iterator[str]:
    """Lines as text: UTF-8, or GB18030 from the first line that is not UTF-8, if none before needed it."""
    encoding, first = None, True
    for line in stream:
        if first:
            line, first = line.removeprefix(b"\xef\xbb\xbf"), False
        if line.isascii():
            yield line.decode("ascii")
            continue
        for tried in (encoding,) if encoding else ("utf-8", "gb18030"):
            try:
                text = line.decode(tried)
            except UnicodeDecodeError:
                continue
            encoding = tried
            break
        else:
            raise Refused("unsupported_encoding")
        yield text


def headed(rows: Iterator[list], width_code: str = "row_column_count") -> Iterator[Columns]:
    """Chunks of columns of a table whose first row names them."""
    header = [str(h).strip() for h in next(rows, [])]
    if len(set(header)) != len(header):
        raise Refused("ambiguous_header")
    if len(header) < 2 or "" in header:
        raise Refused("binary_layout_required")
    held: list[list] = []
    for row in rows:
        if len(row) != len(header):
            raise Refused(width_code)
        held.append(row)
        if len(held) == CHUNK:
            yield dict(zip(header, map(list, zip(*held))))
            held = []
    yield {h: [r[i] for r in held] for i, h in enumerate(header)}


def delimited(name: str, stream: Iterable[bytes]) -> Iterator[Columns]:
    lines = text_lines(stream)
    head = next(lines, "")
    tab = name.lower().endswith((".tsv", ".tab"))
    sep = "\t" if tab else max((",", "\t", ";"), key=head.count)

    def every() -> Iterator[str]:
        yield head
        yield from lines

    return headed(r for r in csv.reader(every(), delimiter=sep) if r)


def _unique(pairs: list[tuple]) -> dict:
    record = dict(pairs)
    if len(record) != len(pairs):
        raise Refused("duplicate_json_key")
    return record


def _parsed(text: str, code: str):
    try:
        return json.loads(text, object_pairs_hook=_unique)
    except json.JSONDecodeError:
        raise Refused(code) from None


def json_rows(name: str, stream: Iterable[bytes]) -> Iterator[Columns]:
    """Objects of one shape, one a line or in an array, or an array of rows below a header."""
    lines = not name.lower().endswith(".json")
    if lines:
        items = (_parsed(x, "invalid_json_line") for x in text_lines(stream) if x.strip())
    else:
        found = _parsed("".join(text_lines(stream)), "invalid_json")
        if not isinstance(found, list):
            raise Refused("json_layout_required")
        items = iter(found)
    first = next(items, None)
    if first is None:
        raise Refused("no_observations")
    if not isinstance(first, dict if lines else (dict, list)):
        raise Refused("json_layout_required")

    def alike() -> Iterator:
        yield first
        for item in items:
            if type(item) is not type(first):
                raise Refused("json_layout_required" if lines and not isinstance(item, dict) else "json_record_shape")
            yield item

    if isinstance(first, list):
        return headed(alike())

    def rows() -> Iterator[list]:
        yield list(first)
        for item in alike():
            if item.keys() != first.keys():
                raise Refused("json_record_shape")
            yield [item[k] for k in first]

    return headed(rows())


@dataclass(frozen=True)
class ArrayHead:
    """What the head of an array file says: type, rows, and where the data begins."""

    dtype: np.dtype
    shape: tuple[int, ...]
    begin: int


def array_head(stream) -> ArrayHead:
    try:
        version = np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, dtype = read(stream)
    except ValueError:
        raise Refused("invalid_file") from None
    if dtype.hasobject:
        raise Refused("unsafe_object_array")
    if len(shape) != 1:
        raise Refused("binary_layout_required")
    return ArrayHead(dtype, shape, stream.tell() if stream.seekable() else 0)


def _named(name: str, values: np.ndarray) -> Columns:
    if values.dtype.names:
        return {n: values[n] for n in values.dtype.names}
    return {name: values}


def array_columns(stream, name: str = "") -> Iterator[Columns]:
    """A one-dimensional array, a chunk of rows after the other."""
    head = array_head(stream)
    left = head.shape[0]
    while left:
        n = min(left, CHUNK)
        data = stream.read(n * head.dtype.itemsize)
        if len(data) < n * head.dtype.itemsize:
            raise Refused("invalid_file")
        yield _named(name, np.frombuffer(data, head.dtype))
        left -= n


def array_file(stream) -> Iterator[Columns]:
    for columns in array_columns(stream):
        if len(columns) < 2:
            raise Refused("binary_layout_required")
        yield columns


def zipped_arrays(stream) -> Iterator[tuple[int, Columns]]:
    """First row and columns: arrays of one length, each under its name, a chunk after the other."""
    with zipfile.ZipFile(stream) as z:
        heads = array_heads(z)
        if sum(len(h.dtype.names or "x") for h in heads.values()) < 2:
            raise Refused("binary_layout_required")
        for name in heads:
            with z.open(name) as data:
                start = 0
                for columns in array_columns(data, name.removesuffix(".npy")):
                    yield start, columns
                    start += len(next(iter(columns.values())))


def array_heads(z: zipfile.ZipFile) -> dict[str, ArrayHead]:
    heads = {}
    for i in z.infolist():
        with z.open(i) as data:
            heads[i.filename] = array_head(data)
    if len({h.shape for h in heads.values()}) > 1:
        raise Refused("binary_column_length")
    return heads


def arrow_columns(stream) -> Iterator[Columns]:
    """Record batches of an Arrow file or stream."""
    try:
        file = pa.ipc.open_file(stream)
        batches: Iterable[pa.RecordBatch] = (file.get_batch(i) for i in range(file.num_record_batches))
        names = file.schema.names
    except pa.ArrowInvalid:
        stream.seek(0)
        opened = pa.ipc.open_stream(stream)
        batches, names = opened, opened.schema.names
    for batch in batches:
        yield _arrow(names, batch)


def _arrow(names: list[str], batch: pa.RecordBatch) -> Columns:
    if len(names) < 2 or len(set(names)) != len(names):
        raise Refused("binary_layout_required" if len(names) < 2 else "ambiguous_header")
    return {n: batch.column(i).to_pylist() for i, n in enumerate(names)}


def decoded(name: str, stream) -> Iterator[tuple[int, Columns]]:
    """First row number and columns of the chunks of one file or member, by its suffix."""
    lower = name.lower()
    if lower.endswith(".npz"):
        yield from zipped_arrays(_seekable(stream))
        return
    if lower.endswith(fv.TEXT_SUFFIXES):
        chunks = delimited(name, stream)
    elif lower.endswith(fv.JSON_SUFFIXES):
        chunks = json_rows(name, stream)
    elif lower.endswith((".parquet", ".pq")):
        import pyarrow.parquet as parquet

        table = parquet.ParquetFile(_seekable(stream))
        chunks = (_arrow(b.schema.names, b) for b in table.iter_batches(CHUNK))
    elif lower.endswith((".feather", ".arrow", ".ipc")):
        chunks = arrow_columns(_seekable(stream))
    elif lower.endswith(".npy"):
        chunks = array_file(stream)
    else:
        raise Refused("unsupported_file_type")
    start = 0
    for columns in chunks:
        yield start, columns
        start += len(next(iter(columns.values())))


def _seekable(stream):
    """A stream that can be read in any order: formats with a directory at their end need one."""
    return stream if stream.seekable() else io.BytesIO(stream.read())


def text_of(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace").strip()
    if hasattr(v, "item"):
        v = v.item()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return (repr(v) if isinstance(v, float) else str(v)).strip()


def cells(source: str, member: str | None, chunks: Iterator[tuple[int, Columns]]) -> Iterator[pa.RecordBatch]:
    """Cells of a file or member; one that is refused on the way ends with a row that has the code."""
    try:
        for start, columns in chunks:
            for column, values in columns.items():
                n = len(values)
                numbers = pa.array(range(start, start + n), pa.int64())
                yield _rows(source, member, n, numbers, column, pa.array(map(text_of, values), pa.string(), size=n), None)
    except Refused as refused:
        yield issue(source, member, str(refused))
    except (OSError, ValueError, EOFError, KeyError, RuntimeError, zlib.error, lzma.LZMAError, zipfile.BadZipFile, pa.ArrowException, csv.Error):
        yield issue(source, member, "invalid_file")


def _rows(source, member, n, numbers, column, texts, code) -> pa.RecordBatch:
    same = lambda v: pa.array([v] * n, pa.string())
    return pa.RecordBatch.from_arrays([same(source), same(member), numbers, same(column), texts, same(code)], schema=CELLS)


def issue(source: str, member: str | None, code: str) -> pa.RecordBatch:
    return _rows(source, member, 1, pa.array([None], pa.int64()), None, pa.array([None], pa.string()), code)


# -- members -------------------------------------------------------------------------------


def member_code(kind: str, name: str, locked: bool = False, link: bool = False) -> str | None:
    """Why an archive with such a member is not read at all."""
    parts = name.split("/")
    unsafe = locked or link or not name or "\\" in name or any(ord(c) < 32 for c in name)
    if unsafe or name.startswith("/") or ".." in parts or (name[1:2] == ":" and name[0].isalpha()):
        return f"unsafe_{kind}_member"
    return None if name.lower().endswith(DATA_SUFFIXES) else "archive_member_unsupported"


def member_key(name: str) -> str:
    """Names that are equal in compatibility form and without case name one member twice."""
    return unicodedata.normalize("NFKC", posixpath.normpath(name)).lower()


# -- the data source -----------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    """What one task reads of a file: members of a zip, rows of an array, the whole of a tar or
    of another file, or nothing but the codes found while planning."""

    source: str
    kind: str
    names: tuple[str, ...] = ()
    first: int = 0
    count: int = 0
    begin: int = 0
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limits:
    """Of an archive; None is none.  ``rows`` of an array and ``size`` of members make a task."""

    members: int | None = None
    member_bytes: int | None = None
    total_bytes: int | None = None
    rows: int = 1 << 20
    size: int = 64 << 20

    def codes(self, n: int, largest: int, total: int) -> set[str]:
        over = lambda value, limit: limit is not None and value > limit
        found = {"too_many_files": over(n, self.members), "expanded_file_too_large": over(largest, self.member_bytes)}
        return {k for k, v in (found | {"expanded_batch_too_large": over(total, self.total_bytes)}).items() if v}


class PackedReader(DataSourceReader):
    def __init__(self, path: str, limits: Limits):
        self.path, self.limits = path, limits

    def partitions(self) -> list[Part]:
        store, names = listed(self.path)
        return [p for name in names for p in self._planned(store, name)] or [Part("", "nothing")]

    def _planned(self, store, name: str) -> list[Part]:
        lower = name.lower()
        try:
            if lower.endswith(".zip"):
                return self._of_zip(store, name)
            if lower.endswith(".npy"):
                with store.open_input_file(name) as f:
                    head = array_head(f)
                if len(head.dtype.names or ()) < 2:
                    return [Part(name, "issue", codes=("binary_layout_required",))]
                return self._ranges(name, "array", head.shape[0], head.begin)
        except Refused as refused:
            return [Part(name, "issue", codes=(str(refused),))]
        except (OSError, ValueError, zipfile.BadZipFile, pa.ArrowException):
            return [Part(name, "issue", codes=("invalid_archive" if lower.endswith(".zip") else "invalid_file",))]
        tar = lower.endswith((".tar", ".tgz", ".tbz2", ".txz", ".tar.gz", ".tar.bz2", ".tar.xz"))
        return [Part(name, "tar" if tar else "gzip" if lower.endswith(".gz") else "file")]

    def _ranges(self, name: str, kind: str, n: int, begin: int) -> list[Part]:
        return [Part(name, kind, first=i, count=min(self.limits.rows, n - i), begin=begin) for i in range(0, n, self.limits.rows)]

    def _of_zip(self, store, name: str) -> list[Part]:
        with store.open_input_file(name) as f, zipfile.ZipFile(_random(f)) as z:
            members = [i for i in z.infolist() if not i.is_dir()]
        codes = {member_code("zip", i.filename, bool(i.flag_bits & 1), (i.external_attr >> 16) & 0o170000 == 0o120000) for i in members}
        if len({member_key(i.filename) for i in members}) < len(members):
            codes.add("duplicate_zip_member")
        if not members:
            codes.add("zip_member_count")
        sizes = [i.file_size for i in members]
        codes |= self.limits.codes(len(sizes), max(sizes, default=0), sum(sizes))
        if codes - {None}:
            return [Part(name, "issue", codes=tuple(sorted(codes - {None})))]
        parts, held, size = [], [], 0
        for i in members:
            held.append(i.filename)
            size += i.file_size
            if size >= self.limits.size:
                parts.append(Part(name, "zip", tuple(held)))
                held, size = [], 0
        return parts + [Part(name, "zip", tuple(held))] * bool(held)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.kind == "nothing":
            return
        store, _ = opened(self.path)
        if part.kind == "issue":
            for code in part.codes:
                yield issue(part.source, None, code)
        elif part.kind == "zip":
            with store.open_input_file(part.source) as f, zipfile.ZipFile(_random(f)) as z:
                for name in part.names:
                    with z.open(name) as data:
                        yield from cells(part.source, name, decoded(name, data))
        elif part.kind == "array":
            yield from cells(part.source, None, self._array_rows(store, part))
        elif part.kind == "tar":
            yield from walked(part.source, store, self.limits)
        elif part.kind == "gzip":
            name = posixpath.basename(part.source).rpartition(".")[0]
            code = member_code("gzip", name)
            with store.open_input_stream(part.source, compression="gzip") as data:
                yield from [issue(part.source, None, code)] if code else cells(part.source, name, decoded(name, io.BufferedReader(data)))
        else:
            with store.open_input_file(part.source) as f:
                yield from cells(part.source, None, decoded(part.source, _random(f)))

    def _array_rows(self, store, part: Part) -> Iterator[tuple[int, Columns]]:
        with store.open_input_file(part.source) as f:
            dtype = array_head(f).dtype
            f.seek(part.begin + part.first * dtype.itemsize)
            for first in range(part.first, part.first + part.count, CHUNK):
                n = min(CHUNK, part.first + part.count - first)
                data = f.read(n * dtype.itemsize)
                if len(data) < n * dtype.itemsize:
                    raise Refused("invalid_file")
                yield first, _named("", np.frombuffer(data, dtype))

def walked(source: str, store, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Cells of the members of a tar in one pass; codes of the archive come where they are found."""
    seen: set[str] = set()
    n = largest = total = 0
    try:
        with store.open_input_stream(source, compression=None) as raw, tarfile.open(fileobj=unpacked(raw), mode="r|") as t:
            for i in t:
                if i.isdir():
                    continue
                code = member_code("tar", i.name, link=not i.isfile())
                if not code and member_key(i.name) in seen:
                    code = "duplicate_tar_member"
                seen.add(member_key(i.name))
                n, largest, total = n + 1, max(largest, i.size), total + i.size
                over = limits.codes(n, largest, total)
                if code or over:
                    for each in sorted(over | {code} - {None}):
                        yield issue(source, None, each)
                else:
                    yield from cells(source, i.name, decoded(i.name, io.BufferedReader(_Forward(t.extractfile(i)))))
        if not seen:
            yield issue(source, None, "tar_member_count")
    except (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError):
        yield issue(source, None, "invalid_archive")


def unpacked(raw) -> io.BufferedIOBase:
    """The bytes behind gzip, bzip2 or xz, by the first bytes; a stream that ends early is an EOFError."""
    data = io.BufferedReader(raw)
    magic = data.peek(6)
    if magic.startswith(b"\x1f\x8b"):
        return gzip.GzipFile(fileobj=data)
    if magic.startswith(b"BZh"):
        return bz2.BZ2File(data)
    return lzma.LZMAFile(data) if magic.startswith(b"\xfd7zXZ\x00") else data


class _Random(io.RawIOBase):
    """A stored file that Python's readers can seek in; a place before its begin is an OSError, as they expect."""

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.at, self.size)[whence]
        if at < 0:
            raise OSError("negative position")
        self.at = at
        return at

    def readinto(self, into) -> int:
        data = self.file.read_at(min(len(into), max(0, self.size - self.at)), min(self.at, self.size))
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


class _Forward(io.RawIOBase):
    """A member of a tar that is read as it comes: forwards only."""

    def __init__(self, member):
        self.member = member

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def readinto(self, into) -> int:
        data = self.member.read(len(into))
        into[: len(data)] = data
        return len(data)


def _random(file) -> io.BufferedReader:
    return io.BufferedReader(_Random(file))


class PackedTables(DataSource):
    """``spark.read.format("packed_tables")``: a folder, a file, or a pattern of file names."""

    @classmethod
    def name(cls) -> str:
        return "packed_tables"

    def schema(self) -> str:
        return CELLS_DDL

    def reader(self, schema) -> PackedReader:
        own = {f.name.replace("_", ""): f.name for f in fields(Limits)}
        return PackedReader(self.options["path"], Limits(**{own[k]: int(v) for k, v in self.options.items() if k in own}))


def read_packed(spark: SparkSession, path: str, folder: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """``(cells, issues)`` of all archives, array files and tables that ``path`` names.

    Every file is unpacked once: what is read is written to ``folder`` (shared by all executors) and
    sorted out from there.  An archive with a code of its own has no cells; a member with a code has none,
    but its neighbours have.  Limits hold only where they are given.
    """
    spark.dataSource.register(PackedTables)
    given = {f.name.replace("_", ""): getattr(limits, f.name) for f in fields(Limits)}
    reader = spark.read.format("packed_tables").options(**{k: v for k, v in given.items() if v is not None})
    reader.load(path).write.mode("overwrite").parquet(folder)
    written = spark.read.schema(CELLS_DDL).parquet(folder)
    issues = written.where(F.col("code").isNotNull()).select("source", "member", "code").distinct()
    refused = issues.select(F.col("source").alias("__source"), F.col("member").alias("__member")).distinct()
    side = F.broadcast(refused) if refused.count() <= BROADCAST_ROWS else refused
    same = F.col("__member").isNull() | (F.col("member") == F.col("__member"))
    found = written.where(F.col("code").isNull()).join(side, (F.col("source") == F.col("__source")) & same, "left_anti")
    return found.drop("code"), issues
