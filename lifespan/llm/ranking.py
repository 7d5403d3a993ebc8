"""Ranked lexical search of many queries at once, their common term sets evaluated once.

Queries come in blocks of bounded size.  In a block, the terms of each query are written in order
of how many queries have them; neighbours that stand together in two queries or more become a node,
and again on what is left, until nothing is shared.  The nodes form a graph without cycles: the
leaves are terms, every other node is the sum of two.  Documents pass in batches; the accumulators
of a batch, one row of numbers for each node, are filled once from the leaves up, and each query
adds up the few nodes that are left of it.

The documents are split into terms once per block; only the places of the block's own terms are
written, and the statistics and scores are made from those.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lifespan.llm.common import cut, new_folder, pieces_of
from lifespan.llm.words import Words, hashes, split, text_bytes


@dataclass(frozen=True)
class Settings:
    """``block``: bytes of query text that are answered together, on average over the blocks;
    ``cells``: numbers held at once for a batch of documents."""

    block: int = 1 << 18
    cells: int = 4_000_000
    top: int = 10


PRODUCTION = Settings()

#: Bytes of terms: ASCII letters and digits (A-Z as a-z) and all of other characters; the rest separates.
_TERM_BYTES = np.full(256, 0x20, dtype=np.uint8)
_TERM_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
_TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM_BYTES[0x80:] = np.arange(0x80, 0x100)


def terms(texts: pa.Array) -> Words:
    """Terms of every text (null: none)."""
    data, bounds = text_bytes(texts)
    buffers = [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(_TERM_BYTES[data].tobytes())]
    return split(pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, buffers))


# -- shared term sets -----------------------------------------------------------


@dataclass
class Sharing:
    """Leaves ``(term, times)``, sums of two earlier nodes, and the nodes each query adds up."""

    leaves: list[tuple[int, int]]
    sums: list[tuple[int, int]]
    queries: list[list[int]]

    @property
    def size(self) -> int:
        return len(self.leaves) + len(self.sums)


def shared_sets(queries: list[Counter]) -> Sharing:
    """The graph of term sets that queries (term numbers with their repeats) have in common."""
    holders = Counter(leaf for q in queries for leaf in q.items())
    leaves = sorted(holders, key=lambda x: (-holders[x], x))
    number = {leaf: i for i, leaf in enumerate(leaves)}
    rows = [sorted(number[leaf] for leaf in q.items()) for q in queries]
    sums: list[tuple[int, int]] = []
    while True:
        together = Counter(pair for row in rows for pair in zip(row, row[1:]))
        made: dict[tuple[int, int], int] = {}
        for k, row in enumerate(rows):
            out, i = [], 0
            while i < len(row):
                pair = tuple(row[i : i + 2])
                # of two overlapping pairs the one that more queries share
                if len(pair) == 2 and together[pair] > 1 and together[pair] >= together[tuple(row[i + 1 : i + 3])]:
                    if pair not in made:
                        made[pair] = len(leaves) + len(sums)
                        sums.append(pair)
                    out.append(made[pair])
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            rows[k] = out
        if not made:
            return Sharing(leaves, sums, rows)


@dataclass
class Block:
    """Queries answered together: their numbers, the hashes of their terms (rising), the sharing."""

    numbers: list[int]
    vocabulary: np.ndarray
    sharing: Sharing


def block_of(numbers: list[int], texts: list[str]) -> Block:
    w = terms(pa.array(texts, pa.string()))
    vocabulary, term = np.unique(hashes(w), return_inverse=True)
    queries = [Counter(x.tolist()) for x in np.split(term, np.cumsum(w.counts())[:-1])]
    return Block(numbers, vocabulary, shared_sets(queries))


# -- documents ------------------------------------------------------------------


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, times`` of the documents (``doc_id`` long, ``text``) that have a term at
    all: its number of terms, and which of the vocabulary it has how often (packed 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in pieces_of(batches, "text"):
            w = terms(batch.column("text"))
            n, value = w.counts(), hashes(w)
            at = np.minimum(np.searchsorted(vocabulary, value), size - 1)
            hit = vocabulary[at] == value if len(vocabulary) else np.zeros(len(value), dtype=bool)
            found, times = np.unique(w.row[hit] * size + at[hit], return_counts=True)
            bounds = np.searchsorted(found, np.arange(len(n) + 1) * size)
            term, times = (found % size).astype("<u4").tobytes(), times.astype("<u4").tobytes()
            some = np.flatnonzero(n)
            spans = [(4 * int(bounds[i]), 4 * int(bounds[i + 1])) for i in some]
            columns = [
                batch.column("doc_id").take(pa.array(some)),
                pa.array(n[some].astype(np.int64)),
                pa.array([term[x:y] for x, y in spans], pa.binary()),
                pa.array([times[x:y] for x, y in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, times binary")


def weights(places: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and the weight of each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, dtype=np.int64)
        for batch in batches:
            every = b"".join(batch.column("terms").to_pylist())
            count += np.bincount(np.frombuffer(every, dtype="<u4"), minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["term", "df"])

    total = places.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    found = places.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(size, dtype=np.int64)
    for r in found.collect():  # a row for each term of the block at most
        weight[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
    return total["n"], total["length"], weight


def accumulators(sharing: Sharing, weighted: np.ndarray) -> np.ndarray:
    """The value of every node for a batch of documents, from those of the terms (terms x documents)."""
    values = np.empty((sharing.size, weighted.shape[1]), dtype=np.int64)
    if sharing.leaves:
        term, times = np.array(sharing.leaves).T
        np.multiply(weighted[term], times[:, None], out=values[: len(term)])
    for node, (x, y) in enumerate(sharing.sums, len(sharing.leaves)):
        np.add(values[x], values[y], out=values[node])
    return values


class Best:
    """The highest-scoring documents of each query so far; equal scores by id, those without id last."""

    def __init__(self, n: int, top: int):
        self.top, self.least = top, np.ones(n, dtype=np.int64)
        self.held = [np.zeros((0, 2), dtype=np.int64) for _ in range(n)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.least[query])
        if not len(some):
            return
        if len(some) > self.top:
            bar = np.partition(scores[some], -self.top)[-self.top]
            some = some[scores[some] >= bar]
        rows = np.concatenate([self.held[query], np.stack([scores[some], ids[some]], axis=1)])
        rows = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[: self.top]]
        self.held[query] = rows
        if len(rows) == self.top:
            self.least[query] = rows[-1, 0]


NO_ID = np.iinfo(np.int64).max


def best_of_tasks(places: DataFrame, block: Block, n_docs: int, length: int, weight: np.ndarray, settings: Settings) -> DataFrame:
    """``query, doc_id, score``: the best of each query among the documents of each task."""
    size, sharing, numbers = len(block.vocabulary), block.sharing, block.numbers
    at_once = max(1, settings.cells // max(1, size + sharing.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(numbers), settings.top)
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                term, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").astype(np.int64) for c in ("terms", "times"))
                if not len(term):
                    continue
                own = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()])
                row = np.repeat(np.arange(batch.num_rows), own)
                # integers of the score: 100 - b, and k1 and b in units that keep it whole
                m = 25 + 75 * batch.column("n").to_numpy() * n_docs // length
                weighted = np.zeros((size, batch.num_rows), dtype=np.int64)
                weighted[term, row] = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
                values = accumulators(sharing, weighted)
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
                for q, nodes in enumerate(sharing.queries):
                    if nodes:
                        best.add(q, values[nodes[0]] if len(nodes) == 1 else values[nodes].sum(axis=0), ids)
        query = np.repeat(np.array(numbers, dtype=np.int64), [len(x) for x in best.held])
        rows = np.concatenate([np.zeros((0, 2), dtype=np.int64), *best.held])
        ids = pa.array(rows[:, 1], mask=rows[:, 1] == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(rows[:, 0])], ["query", "doc_id", "score"])

    return places.mapInArrow(run, "query long, doc_id long, score long")


def rank(
    docs: DataFrame, items: DataFrame, settings: Settings = PRODUCTION, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item, rank, doc_id, score``: the ``top`` best documents of every row of ``items``.

    The score is the sum over the item's terms (repeats too) of integer weights, as the contract of
    ``op12`` gives it.  Null or empty texts of either side have no terms: such documents count in no
    statistic, such items have no rows.  Equal scores come by rising id, documents without id last.
    Rows of ``items`` with one text share the work and have the same list.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("query_text")).filter("length(query_text) > 0")
    distinct = cut(wanted.select("query_text").distinct().withColumn("query", F.monotonically_increasing_id()))
    sized = distinct.agg(F.coalesce(F.sum(F.octet_length("query_text")), F.lit(0)).alias("n")).first()
    blocks = max(1, -(-sized["n"] // settings.block))
    found = []
    for k in range(blocks):
        # a block has a bounded size, whatever the number of queries
        own = distinct.filter(F.pmod(F.xxhash64("query_text"), F.lit(blocks)) == k).orderBy("query").collect()
        block = block_of([r["query"] for r in own], [r["query_text"] for r in own])
        if not len(block.vocabulary):
            continue
        folder = new_folder(spark, "ranking")
        postings(chosen, block.vocabulary).write.option("compression", "zstd").parquet(folder)
        places = spark.read.parquet(folder)
        n_docs, length, weight = weights(places, len(block.vocabulary))
        if n_docs:
            found.append(best_of_tasks(places, block, n_docs, length, weight, settings))
    schema = "query long, doc_id long, score long"
    best = spark.createDataFrame([], schema)
    for part in found:
        best = best.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # first the best of a share of the tasks, so that the last step has few rows whatever the number of tasks
    shares = Window.partitionBy("query", "share").orderBy(*order)
    few = best.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("rank", F.row_number().over(shares))
    few = few.filter(F.col("rank") <= settings.top).select("query", "doc_id", "score")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= settings.top)
    listed = wanted.join(distinct, "query_text").select("item_id", "query")
    return listed.join(ranked, "query").select("item_id", "rank", "doc_id", "score")
