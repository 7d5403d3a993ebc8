"""Token ids as length-delimited binary records with an offset index.

A shard is one file of frames::

    u64 length of the payload | u32 masked CRC-32 of those 8 bytes
    payload: u64 key presence and key | u8 bytes per id | ids, little-endian
    u32 masked CRC-32 of the payload

and a second file beside it with one fixed-size entry per record (key, offset, number of ids), so
that records can be read in any order.  A checksum is stored rotated and shifted by a constant, as
checksums of data that hold checksums are weak otherwise.
"""

from __future__ import annotations

import os
import struct
import uuid
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lifespan.llm.common import cut, partitions_of, per_process, pieces_of

HEAD, KEY, FOOT = "<QI", "<BqB", "<I"
HEAD_SIZE, FOOT_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOT)
#: Index entries: whether there is a key, the key, offset of the frame, number of ids.
ENTRY = np.dtype([("keyed", "u1"), ("key", "<i8"), ("offset", "<u8"), ("n_ids", "<u4")])
_MASK = 0xA282EAD8
TABLE_LIMIT = 600_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack(KEY, key is not None, key or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(FOOT, masked(length)) + payload + struct.pack(FOOT, masked(payload))


def unframe(data: bytes | memoryview, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """Key, ids and the offset of the next frame; a wrong checksum is an error."""
    length, crc = struct.unpack_from(HEAD, data, offset)
    if masked(bytes(data[offset : offset + 8])) != crc:
        raise ValueError(f"length at {offset} is damaged")
    begin = offset + HEAD_SIZE
    payload = bytes(data[begin : begin + length])
    if len(payload) != length or masked(payload) != struct.unpack_from(FOOT, data, begin + length)[0]:
        raise ValueError(f"record at {offset} is damaged")
    keyed, key, width = struct.unpack_from(KEY, payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(KEY)).astype("<u4")
    return (key if keyed else None), ids, begin + length + FOOT_SIZE


# -- encoding -------------------------------------------------------------------


#: White space below U+0180 as the tokenizer's pattern has it (without the separators U+001C to U+001F).
_PLAIN_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"


def _plain_letters() -> str:
    return "".join(chr(i) for i in range(0x180) if unicodedata.category(chr(i))[0] == "L")


def _plain_numbers() -> str:
    return "".join(chr(i) for i in range(0x180) if unicodedata.category(chr(i))[0] == "N")


def _byte_letters() -> list[str]:
    """The printable character that a byte-level vocabulary uses for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordTable:
    """Ids of texts by one word-level BPE tokenizer of the tokenizers library.

    The tokenizer lower-cases, drops white space and merges inside runs of letters, single
    numbers and runs of signs.  In texts below U+0180 (no combining marks, so composing characters
    changes nothing) those runs are cut here and each distinct one is merged once by the library's
    model.  All other texts, and those that may hold a special token, are encoded whole.
    """

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.limit, self.ids = limit, {}
        self.far = re.compile("[\\u0180-\\U0010ffff]|<\\|")
        letters, numbers = re.escape(_plain_letters()), re.escape(_plain_numbers())
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_PLAIN_SPACE}{letters}{numbers}]+")
        self.shown = {b: c for b, c in enumerate(_byte_letters())}

    def encode(self, text: str) -> np.ndarray:
        if self.far.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(self.ids) > self.limit:
            self.ids = {}
        ids, words = self.ids, self.word.findall(text.lower())
        for word in {w for w in words if w not in ids}:
            shown = word if word.isascii() and word.isprintable() else "".join(self.shown[b] for b in word.encode())
            ids[word] = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], dtype="<u4").tobytes()
        return np.frombuffer(b"".join(map(ids.__getitem__, words)), dtype="<u4")


def word_table(path: str, limit: int) -> WordTable:
    return per_process(f"words {path} {limit}", lambda: WordTable(path, limit))


# -- writing and reading --------------------------------------------------------


def _store(url: str):
    """A file system and the path in it; any that pyarrow knows by its address, else local."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:"):
        return fs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))
    return fs.LocalFileSystem(), url


MANIFEST = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the token ids of each text in ascending key order; returns the manifest, a row per shard.

    Shards are cut by ranges of the key, so their order is the order of keys (null first; rows of
    one key by text).  Each attempt of a task writes files under a name of its own, and the manifest
    has the name of the attempt that counted, so nothing is renamed or written over; files of
    other attempts are removed at the end.  Null text counts as empty: its record holds the end id
    alone.  An empty table gives an empty manifest.
    """
    order = [F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first()]
    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # cut by key alone: the cuts come from a sample that reaches the driver
    ranged = chosen.repartitionByRange(partitions_of(docs.sparkSession), order[0]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, root = _store(folder)
        name = f"part-{shard:06d}-{uuid.uuid4().hex[:12]}"
        table = word_table(tokenizer, TABLE_LIMIT)
        last = np.array([end_id], dtype="<u4")
        offset = n_ids = n = 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}.rec") as out, store.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in pieces_of(batches, "text"):
                entries = np.zeros(batch.num_rows, dtype=ENTRY)
                frames = []
                for i, (k, t) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())):
                    ids = np.concatenate([table.encode(t or ""), last])
                    frames.append(frame(k, ids, table.width if end_id < 1 << 8 * table.width else 4))
                    entries[i] = (k is not None, k or 0, offset, len(ids))
                    offset, n_ids, n = offset + len(frames[-1]), n_ids + len(ids), n + 1
                out.write(b"".join(frames))
                index.write(entries.tobytes())
        if n:
            row = {"shard": shard, "file": name, "n_records": n, "n_ids": n_ids, "n_bytes": offset}
            yield pa.RecordBatch.from_pylist([row])

    manifest = cut(ranged.mapInArrow(run, MANIFEST))
    _remove_others(folder, {r["file"] for r in manifest.select("file").collect()})
    return manifest


def _remove_others(folder: str, named: set[str]) -> None:
    """Files of attempts that failed or came second, and of shards without records."""
    from pyarrow import fs

    store, root = _store(folder)
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("part-") and info.base_name.rpartition(".")[0] not in named:
            store.delete_file(info.path)


def read_records(manifest: DataFrame, folder: str, chunk: int = 8 << 20) -> DataFrame:
    """Every record from the files: ``key, start, n_ids, ids`` (binary, little-endian 32-bit).

    ``start`` is the number of ids of all records before it.  Files are read in chunks and every
    checksum is looked at.  Only the manifest, a row per shard, is put in one order.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    spread = placed.repartition(partitions_of(manifest.sparkSession), "shard")
    schema = "key long, start long, n_ids long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{root}/{file}.rec") as data:
                    held, rows = b"", []
                    while got := data.read(chunk):
                        held, at = held + got, 0
                        while len(held) - at >= HEAD_SIZE:
                            length, _ = struct.unpack_from(HEAD, held, at)
                            if len(held) - at < HEAD_SIZE + length + FOOT_SIZE:
                                break
                            key, ids, at = unframe(held, at)
                            rows.append((key, start, len(ids), ids.tobytes()))
                            start += len(ids)
                        held = held[at:]
                        if rows:
                            yield _batch(rows)
                            rows = []
                    if held:
                        raise ValueError(f"{file} ends within a record")

    return spread.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, start, n_ids, ids = zip(*rows)
    columns = [pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(n_ids, pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "start", "n_ids", "ids"])


def read_at(folder: str, file: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of a shard by their number, in any order, by the index alone."""
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{file}.idx") as index:
        entries = np.frombuffer(index.read(), dtype=ENTRY)
    out = []
    with store.open_input_file(f"{root}/{file}.rec") as data:
        for number in numbers:
            data.seek(int(entries[number]["offset"]))
            head = data.read(HEAD_SIZE)
            length, _ = struct.unpack(HEAD, head)
            key, ids, _ = unframe(head + data.read(length + FOOT_SIZE))
            out.append((key, ids))
    return out
