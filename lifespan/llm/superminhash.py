"""Near duplicates by SuperMinHash signatures, banding, verification and connected components.

1. Each text becomes its set of word shingles, a digest of the set, and the keys of its bands.
   Texts with the same set are one node from here on.
2. In each bucket of a band every node is verified against the first one.  Those links give
   components.
3. Buckets that still hold several components are compared node by node, in blocks of bounded
   size, by their signatures, and what may reach the threshold is verified on the full sets.  So
   no pair that shares a bucket is left out, while pairs already connected cost nothing.
4. Components of all links; each takes the smallest id of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifespan.llm.common import cut, free_names, partitions_of, pieces_of, whole_text

from lifespan.llm.words import hashes, mixed, run_starts, runs, split

_U = np.uint64
BANDS, ROWS, SHINGLE = 28, 5, 5


def shingles(texts, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of every text as sorted 64-bit values, and where each text's begin.

    A-Z count as a-z.  A text with fewer words is one shingle, one without words has none.
    """
    w = split(texts, fold=True)
    value, counts = hashes(w), w.counts()
    at = run_starts(w, length)
    found, rows = [runs(value, length)[at]], [w.row[at]]
    begin = w.bounds()[:-1]
    for short in range(1, length):
        few = np.flatnonzero(counts == short)
        if len(few):
            found.append(runs(value, short)[begin[few]])
            rows.append(few)
    h, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    h, row = h[new], row[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=w.n_rows))])


def signatures(elements: np.ndarray, bounds: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of many sets, a row each: per slot the least of rank + fraction.

    Each element draws its own permutation of the slots step by step; at step j it offers
    ``j + fraction`` to the j-th slot of its permutation.  Offers of step j are at least j, so once
    every slot of a set holds less no later step can change it, and the set is left out from then
    on: long sets end after a step or two.
    """
    n_sets = len(bounds) - 1
    least = np.full(n_sets * size, np.inf)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))
    order = first = None
    for j in range(size):
        drawn = mixed(elements ^ mixed(np.uint64([j]))[0])
        chosen = (((drawn >> _U(32)) * _U(size - j)) >> _U(32)).astype(np.int64) + j
        if j == 0:
            slot = first = chosen
        else:
            at = np.arange(len(elements))
            if order is None:
                # permutations are written down only for sets that need a second step
                order = np.tile(np.arange(size, dtype=np.uint8), (len(elements), 1))
                order[at, first] = 0
                order[:, 0] = first
            slot = order[at, chosen].astype(np.int64)
            order[at, chosen] = order[:, j]
            order[:, j] = slot
        np.minimum.at(least, owner * size + slot, j + (drawn & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        going = least.reshape(n_sets, size).max(axis=1) >= j + 1
        keep = going[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner, first = elements[keep], owner[keep], first[keep]
            order = None if order is None else order[keep]
    return least.reshape(n_sets, size)


def short_values(least: np.ndarray) -> np.ndarray:
    """Sixteen bits of each slot: enough to compare two signatures slot by slot."""
    return (mixed(least.view(np.uint64)) >> _U(48)).astype(np.uint16)


def band_keys(short: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit value per set and band of its signature, different in different bands."""
    value = short.reshape(len(short), bands, -1).astype(np.uint64)
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(short), 1))
    for k in range(value.shape[2]):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + value[:, :, k])
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


# -- on Spark -------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """``slack`` is how far below the threshold a signature may estimate a pair (five deviations)."""

    percent: int = 80
    slack: float = 0.16
    block: int = 1000


PRODUCTION = Settings(percent=85)
SLICE = 1 << 20


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (hash of the text), ``n_shingles``, digest of the set, band keys."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(whole_text()).alias("print"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", SLICE):
            elements, bounds = shingles(batch.column("text"))
            sizes = np.diff(bounds)
            own = np.flatnonzero(sizes)
            begin = bounds[:-1][own]
            lanes = [np.zeros(len(sizes), dtype=np.uint64) for _ in range(2)]
            for k, lane in enumerate(lanes):
                if len(own):
                    lane[own] = np.add.reduceat(mixed(elements + _U(k)), begin)
            keys = band_keys(short_values(signatures(elements, bounds)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            columns = [batch.column("doc_id"), batch.column("print"), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in lanes), rows]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n_shingles", "digest_a", "digest_b", "bands"])

    schema = "doc_id long, print long, n_shingles long, digest_a long, digest_b long, bands array<long>"
    return chosen.mapInArrow(run, schema)


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, elements, short``: full set and signature of the wanted nodes, from their texts."""
    key = wanted.select("node", F.col("doc_id").alias("w_id"), F.col("print").alias("w_print"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(whole_text()).alias("print"))
    found = chosen.join(key, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("print") == F.col("w_print"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", SLICE):
            elements, bounds = shingles(batch.column("text"))
            short = short_values(signatures(elements, bounds))
            sets = [elements[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            columns = [batch.column("node"), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in short], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "elements", "short"])

    # a repeated row gives its node twice
    return found.mapInArrow(run, "node long, elements binary, short binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets reach the threshold."""
    left = packed.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = packed.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), settings.percent) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _close_pairs(group: pa.Table, settings: Settings) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one cell that may reach the threshold: of different components, of the parts
    the cell is there for, alike by signature, and with no earlier band in common."""
    band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
    comp, part = group.column("comp").to_numpy(), group.column("part").to_numpy()
    short = np.frombuffer(b"".join(group.column("short").to_pylist()), dtype=np.uint16).reshape(len(comp), -1)
    least = settings.percent / 100 - settings.slack
    for a in range(len(comp)):
        other = np.flatnonzero((comp[a + 1 :] != comp[a]) & ((i == j) | (part[a + 1 :] != part[a]))) + a + 1
        if not len(other):
            continue
        same = short[other] == short[a]
        other, same = other[same.mean(axis=1) >= least], same[same.mean(axis=1) >= least]
        if len(other):
            first = same.reshape(len(other), BANDS, -1).all(axis=2).argmax(axis=1)
            for b in other[first == band].tolist():
                yield a, b


def _cells(member: DataFrame, labels: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """Rows of the buckets that hold several components, once per pair of blocks they stand in.

    The largest component of a bucket is not compared with itself, so its blocks only meet those of
    the other nodes: a bucket of one component and a few outsiders costs a pass over it.
    """
    named = member.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counted = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed_ = counted.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps"))
    blocks = lambda n: F.ceil(n / F.lit(settings.block)).cast("int")
    mixed_ = mixed_.filter("comps > 1").select(
        "key", F.col("big.comp").alias("big"), blocks(F.col("big.n")).alias("inner"), blocks(F.col("all") - F.col("big.n")).alias("outer")
    )
    placed = named.join(mixed_, "key")
    # blocks of the largest component come first, then those of the others
    large, node = F.col("comp") == F.col("big"), F.xxhash64("node")
    part = F.when(large, F.pmod(node, F.col("inner"))).otherwise(F.col("inner") + F.pmod(node, F.col("outer"))).cast("int")
    first = F.when(large, F.col("inner")).otherwise(F.lit(0))
    against = F.sequence(first, F.col("inner") + F.col("outer") - 1)
    each = placed.withColumn("part", part).withColumn("other", F.explode(against))
    return each.select("key", "band", "node", "comp", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def _by_cell(rows: DataFrame, packed: DataFrame, columns: list[str]) -> DataFrame:
    joined = rows.join(packed.select("node", *columns), "node")
    return joined.repartition(partitions_of(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def _cross_links(member: DataFrame, labels: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """Links ``a, b`` between different components among all pairs that share a bucket."""
    cells = _cells(member, labels, packed, settings)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            rows = sorted({r for pair in _close_pairs(group, settings) for r in pair})
            if rows:
                yield group.select(names).take(rows).combine_chunks().to_batches()[0]

    names = ["key", "band", "node", "comp", "part", "i", "j"]
    schema = "key long, band int, node long, comp long, part int, i int, j int"
    close = cut(_by_cell(cells, packed, ["short"]).select(*names, "short").mapInArrow(near, schema))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            node, comp = group.column("node").to_pylist(), group.column("comp").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("elements").to_pylist()]
            root = {c: c for c in comp}
            links = []
            for a, b in _close_pairs(group, settings):
                # what this cell has connected already needs no further link
                x, y = _root(root, comp[a]), _root(root, comp[b])
                if x != y and similar(sets[a], sets[b], settings.percent):
                    root[x] = y
                    links.append((node[a], node[b]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    ready = _by_cell(close, packed, ["short", "elements"]).select(*names, "short", "elements")
    return ready.mapInArrow(verify, "a long, b long")


def _root(root: dict[int, int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node with a link; ``comp`` is the smallest node it can reach.

    Alternating large and small stars: each round points nodes at the least of their neighbours,
    by aggregation and joins, until the links no longer change.  Only a count and a checksum reach
    the driver.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(links.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # larger neighbours go to the least neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # smaller neighbours, and the node itself, go to the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
        before = state


def near_duplicates(docs: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """Per row of ``docs``: ``doc_id, print, n_shingles, component_id, kept, stays``.

    ``component_id`` is the smallest id that can be reached over links (texts with the same set are
    linked), ``kept`` whether it is the row's own.  Null and empty texts have no shingles and are
    linked with nothing.  Rows without an id are linked like others but name a component only if no
    row of it has one.  ``stays`` marks one row of each component, also where ids are repeated.
    """
    rows = cut(sketches(docs)).withColumn("row", F.monotonically_increasing_id())
    sets = rows.filter("n_shingles > 0")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    heads = cut(sets.groupBy("digest_a", "digest_b", "n_shingles").agg(F.min("row").alias("node"), F.min(name).alias("name")))
    nodes = sets.join(heads.select(F.col("node").alias("row")), "row", "left_semi")
    buckets = nodes.select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = cut(buckets.join(crowded, "key"))
    wanted = member.select("node").distinct().join(rows.select(F.col("row").alias("node"), "doc_id", "print"), "node")
    packed = cut(_packed(docs, wanted))
    stars = member.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(_verified(stars, packed, settings))
    labels = components(links)
    more = cut(_cross_links(member, labels, packed, settings))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    named = heads.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("name").alias("least"))
    own = named.join(least, "comp").select("digest_a", "digest_b", F.col("n_shingles").alias("n"), "least")
    same = [rows["digest_a"] == own["digest_a"], rows["digest_b"] == own["digest_b"], rows["n_shingles"] == own["n"]]
    linked = rows.filter("n_shingles > 0").join(own, same).select("doc_id", "print", "n_shingles", "row", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "print", "n_shingles", "row", F.col("doc_id").alias("component_id"), F.col("row").alias("first"))
    every = linked.unionByName(alone)
    return every.select("doc_id", "print", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("first")).alias("stays"))


def keep_one(docs: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, columns unchanged.

    Null texts and texts without a word are like nothing and stay; of rows that are equal one stays,
    and of equal texts the one with the smallest id (null last).  Columns of any name stay, and an empty
    table stays empty.
    """
    w_id, w_print, single = free_names(docs, "w_id", "w_print", "single__")
    judged = near_duplicates(docs, settings).groupBy("doc_id", "print").agg(F.count_if("stays").alias("n_stay"), F.count(F.lit(1)).alias("n"))
    # of rows that are repeated as they are only one may stay
    going = judged.filter("n_stay > 0").select(F.col("doc_id").alias(w_id), F.col("print").alias(w_print), (F.col("n") > F.col("n_stay")).alias(single))
    matched = docs.join(going, F.col("doc_id").eqNullSafe(F.col(w_id)) & (F.xxhash64(whole_text()) == F.col(w_print)))
    once = matched.filter(single).dropDuplicates([w_id, w_print])
    return matched.filter(~F.col(single)).unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))
