"""Homomorphic multiset fingerprints of documents.

A paragraph is hashed to a wide vector; a document's fingerprint is the sum of the vectors of its
paragraphs modulo powers of two.  The sum does not depend on their order, and a paragraph is added
or taken away by adding or subtracting its vector.  A vector has two parts:

* ``EQUAL`` lanes modulo 2**32, pseudo-random in the whole paragraph: equal multisets of paragraphs
  have equal lanes, others differ but for hash collisions;
* ``NEAR`` lanes modulo 2**32, the signed counts of the paragraph's runs of three words: their
  cosine estimates how alike two texts are (standard error about 0.05).  They hold 2**31 runs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifespan.llm.common import partitions_of, pieces_of
from lifespan.llm.words import hashes, runs, split

EQUAL, NEAR, RUN = 32, 512, 3
SIZE = EQUAL * 4 + NEAR * 4


class Prints:
    """Fingerprints of many texts: ``equal`` (uint32) and ``near`` (uint32), a row per text."""

    def __init__(self, equal: np.ndarray, near: np.ndarray):
        self.equal, self.near = equal, near

    @classmethod
    def of(cls, texts: list[str]) -> Prints:
        equal = np.zeros((len(texts), EQUAL), dtype=np.uint32)
        for i, text in enumerate(texts):
            drawn = b"".join(hashlib.shake_128(p.encode()).digest(EQUAL * 4) for p in text.split("\n") if p)
            if drawn:
                equal[i] = np.frombuffer(drawn, dtype="<u4").reshape(-1, EQUAL).sum(axis=0, dtype=np.uint32)
        return cls(equal, _near(texts))

    def row(self, i: int) -> bytes:
        return self.equal[i].astype("<u4").tobytes() + self.near[i].astype("<u4").tobytes()


def _near(texts: list[str]) -> np.ndarray:
    w = split(pa.array(texts, pa.string()))
    n = len(w.start)
    if not n:
        return np.zeros((len(texts), NEAR), dtype=np.uint32)
    lines = np.cumsum(w.data == 10)[w.start]
    group = np.concatenate([[True], (w.row[1:] != w.row[:-1]) | (lines[1:] != lines[:-1])])
    first = np.flatnonzero(group)
    length = np.diff(np.concatenate([first, [n]]))
    value = hashes(w)
    number = np.cumsum(group) - 1
    at = np.flatnonzero(number[: n - RUN + 1] == number[RUN - 1 :]) if n >= RUN else np.zeros(0, dtype=np.int64)
    found, rows = [runs(value, RUN)[at]], [w.row[at]]
    for short in range(1, RUN):
        # a paragraph of fewer words is one run
        begin = first[length == short]
        if len(begin):
            found.append(runs(value, short)[begin])
            rows.append(w.row[begin])
    h, row = np.concatenate(found), np.concatenate(rows)
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1
    slot = row * NEAR + (h % np.uint64(NEAR)).astype(np.int64)
    return np.bincount(slot, weights=sign, minlength=len(texts) * NEAR).astype(np.int64).astype(np.uint32).reshape(len(texts), NEAR)


def fingerprint(text: str | None) -> bytes:
    return Prints.of([text or ""]).row(0)


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """Fingerprint of the paragraphs of both, or with ``sign=-1`` of those of a without those of b."""
    out = []
    for kind, part in (("<u4", slice(0, EQUAL * 4)), ("<u4", slice(EQUAL * 4, SIZE))):
        x, y = np.frombuffer(a[part], kind), np.frombuffer(b[part], kind)
        out.append((x + y if sign > 0 else x - y).astype(kind).tobytes())
    return b"".join(out)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints, else the cosine of their signed counts, 0 at least."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(p[EQUAL * 4 :], "<i4").astype(float) for p in (a, b))
    norm = np.sqrt(x @ x) * np.sqrt(y @ y)
    return float(np.clip(x @ y / norm, 0, 1)) if norm else 0.0


def shown(a: bytes) -> str:
    return base64.b64encode(a).decode()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the following text's."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# -- documents beside their successors ------------------------------------------


def beside_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows in descending ``doc_id`` (null last, then by text) within blocks: ``block, guest, doc_id, text``.

    Blocks are cut at quantiles of the id.  Behind the rows of a block stands one guest, the first
    row of the block that follows (behind the last block that of the first), so each row's successor
    stands next to it and texts are shuffled once.  What reaches the driver is an id per block.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * partitions_of(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = [i / blocks for i in range(1, blocks)]
    found = rows.agg(F.percentile_approx("doc_id", parts, 20 * blocks).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(found, dtype=np.int64))

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        # the block of the largest ids is 0; rows without an id come behind all others
        place = len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy(dtype=np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, place))

    placed = rows.withColumn("block", block_of("doc_id"))
    heads = sorted((r["block"], r["head"]) for r in placed.groupBy("block").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return placed.select("block", F.lit(0).alias("guest"), "doc_id", "text")
    before = [heads[i - 1][0] for i in range(len(heads))]
    table = spark.createDataFrame([(h, b) for (_, h), b in zip(heads, before)], "head long, to long")
    first = placed.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head")))
    guests = first.groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    every = placed.select("block", F.lit(0).alias("guest"), "doc_id", "text").unionByName(
        guests.select(F.col("to").alias("block"), F.lit(1).alias("guest"), "doc_id", "text")
    )
    order = ["block", "guest", F.col("doc_id").desc_nulls_last(), "text"]
    return every.repartition(partitions_of(spark), "block").sortWithinPartitions(*order)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited", T.StringType()),
        T.StructField("fingerprint", T.BinaryType()),
        T.StructField("edited_fingerprint", T.BinaryType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Per row: fingerprint, edited text, its fingerprint, and likeness to it and to the next row.

    Null text counts as empty; a single row is its own successor.  Repeated ids stay, in order of
    their texts.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: block, guest, id, text, fingerprint
        for batch in pieces_of(batches, "text"):
            block, guest, ids, texts = (batch.column(c).to_pylist() for c in ("block", "guest", "doc_id", "text"))
            made = Prints.of(texts)
            rows = [held] if held else []
            rows += [(b, g, i, t, made.row(k)) for k, (b, g, i, t) in enumerate(zip(block, guest, ids, texts))]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            held = rows[-1]
            if not pairs:
                continue
            new = [edited(a[3], b[3]) for a, b in pairs]
            prints = Prints.of(new)
            out = []
            for k, (a, b) in enumerate(pairs):
                own = prints.row(k)
                out.append((a[2], len(a[3]), new[k], a[4], own, likeness(a[4], own), likeness(a[4], b[4])))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], RESULT.names)

    return beside_next(docs, blocks).mapInArrow(run, RESULT)
