"""Encoding and decoding with a SentencePiece BPE model through a table of distinct chunks.

Pieces of such a model never hold a marker behind another character (checked when it is loaded),
so a text falls into chunks that each begin with a run of markers, and the ids of the text are the
ids of its chunks in order.  Each distinct chunk is segmented once per worker process; the table
is bounded and begins anew when it is full, which costs time but changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lifespan.llm.common import free_names, per_process, pieces_of

MARK = "▁"
TABLE_LIMIT = 400_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Ids of texts by one model, as little-endian 32-bit values."""

    def __init__(self, model: str, limit: int = TABLE_LIMIT):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.limit, self.ids = limit, {}

    def encode(self, text: str) -> bytes:
        """Ids of one text as the library gives them, without begin and end."""
        if not text:
            return b""
        if self.crossing:
            return _packed(self.sp.encode(text))
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            marked = MARK + text.replace(" ", MARK)
            chunks = [c[1:].replace(MARK, " ") for c in _CHUNK.findall(marked)]
        else:
            chunks = text.split(" ")
        if len(self.ids) > self.limit:
            self.ids = {}
        missing = list({c for c in chunks if c not in self.ids})
        for chunk, ids in zip(missing, self.sp.encode(missing)):
            # the library adds no marker to an empty text; an empty chunk is the marker alone
            self.ids[chunk] = _packed(ids if chunk else [self.sp.piece_to_id(MARK)])
        return b"".join(map(self.ids.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, dtype="<u4").tolist())


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def chunk_table(model: str, limit: int) -> ChunkTable:
    return per_process(f"chunks {model} {limit}", lambda: ChunkTable(model, limit))


def encode_decode(
    docs: DataFrame, model: str, text: str = "text", begin_end: bool = True, limit: int = TABLE_LIMIT, decode: bool = True
) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian 32-bit) and ``decoded`` behind its columns.

    Exactly the ids of ``SentencePieceProcessor.encode`` with begin and end ids, and the text of
    its ``decode``.  Null text counts as empty (begin and end only, decoded ``""``).  Columns named
    ``ids`` or ``decoded`` stay; the new ones then get an underscore.  No shuffle, no state over
    rows but the bounded table, rows in and rows out one to one.
    """
    ids_name, decoded_name = free_names(docs, "ids", "decoded")
    fields = [T.StructField(ids_name, T.BinaryType())] + [T.StructField(decoded_name, T.StringType())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model, limit)
        head = np.array([table.sp.bos_id()], dtype="<u4").tobytes() if begin_end else b""
        tail = np.array([table.sp.eos_id()], dtype="<u4").tobytes() if begin_end else b""
        for batch in pieces_of(batches, text):
            texts = batch.column(text).to_pylist()
            ids = [head + table.encode(t or "") + tail for t in texts]
            columns = [pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([table.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
