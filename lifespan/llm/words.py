"""Words of many texts at once, as NumPy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lifespan.llm.common import per_process

_U = np.uint64
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_STEP = _U(0x9E3779B97F4A7C15)
_SPAN = 64


def _table() -> np.ndarray:
    """Random values by place in the word (modulo 64) and byte; the same in every process."""
    return per_process("word table", lambda: np.random.PCG64(20240607).random_raw(_SPAN * 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of the public SplitMix64 generator)."""
    x = x + _STEP
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words in text order: byte range in ``data``, and the text each stands in."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    n_rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def bounds(self) -> np.ndarray:
        """Word numbers at which the texts begin, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and ends; null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def split(texts: pa.Array, fold: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; with ``fold`` A-Z as a-z."""
    data, bounds = text_bytes(texts)
    if fold:
        data = _FOLD[data]
    n, rows = len(data), len(bounds) - 1
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_GAPS[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1])) if n else np.zeros(0, dtype=np.int64)
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1 if n else np.zeros(0, dtype=np.int64)
    row = np.searchsorted(bounds, start, side="right") - 1
    return Words(data, start, end, row, rows)


def hashes(w: Words) -> np.ndarray:
    """A 64-bit value of each word: sums of random table values by place and byte."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    length = w.end - w.start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    within = np.arange(int(length.sum()), dtype=np.int64)
    within -= np.repeat(first, length)
    at = within + np.repeat(w.start, length)
    value = _table()[(within & (_SPAN - 1)) * 256 + w.data[at]]
    if length.max() > _SPAN:
        value = value * ((within // _SPAN).astype(np.uint64) * _U(2) + _U(1))
    return mixed(np.add.reduceat(value, first) + length.astype(np.uint64) * _STEP)


def runs(word_hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit value of each run of ``length`` words, by its first word (whatever text it is in)."""
    n = len(word_hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.full(n, length, dtype=np.uint64)
    for i in range(length):
        value = value * _U(0x2545F4914F6CDD1D) + word_hashes[i : i + n]
    return mixed(value)


def run_starts(w: Words, length: int) -> np.ndarray:
    """Word numbers at which a run of ``length`` words of one text begins."""
    n = len(w.row) - length + 1
    return np.flatnonzero(w.row[:n] == w.row[length - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
