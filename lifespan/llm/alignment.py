"""Which tokens of two tokenizers cover the same bytes of a text.

Both tokenizations end tokens at byte offsets.  The shorter list of ends drives an exponential and
then a binary search into the longer one; ends found in both cut the text into groups, and the
ranks of all others give the range of tokens each token overlaps.

Neither tokenizer lets a token cross a space that has no space before it and a letter, digit or
other visible character behind it, so a text falls into chunks there.  Each distinct chunk is
encoded and aligned once per worker while a bounded table lasts, many chunks in one search; a text
is the row of its chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifespan.llm.common import free_names, new_folder, per_process, pieces_of

MARK = "▁"
#: White space that can stand for a chunk border: nothing that either tokenizer may join to its left.
_BORDER = re.compile(r"(?<=[^ ]) (?=[\w!-~])")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Settings:
    """``table``: distinct chunks a worker holds; ``joined``: characters encoded at once;
    ``slice_pairs``: id pairs that are sent to all tasks at once (12 bytes each)."""

    table: int = 400_000
    joined: int = 60_000
    slice_pairs: int = 4_000_000


PRODUCTION = Settings()


# -- galloping intersection -----------------------------------------------------


def gallop(values: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each of ``values`` (rising) the first place in ``into`` (rising) that is not below it.

    Every search starts where the value's rank suggests, doubles its step until the value is
    passed, and halves the range that is left; all searches go on side by side.
    """
    n, m = len(into), len(values)
    if not n or not m:
        return np.zeros(m, dtype=np.int64)
    start = np.arange(m, dtype=np.int64) * n // m
    low, high = start.copy(), start.copy()
    # invariant at the end: into[low - 1] < value <= into[high], with places outside as infinities
    below = into[start] < values
    up, down = np.flatnonzero(below), np.flatnonzero(~below)
    low[up] += 1
    step = 1
    while len(up):
        reach = np.minimum(low[up] + step - 1, n)
        high[up] = reach
        passed = (reach == n) | (into[np.minimum(reach, n - 1)] >= values[up])
        up = up[~passed]
        low[up] = high[up] + 1
        step *= 2
    step = 1
    while len(down):
        reach = np.maximum(high[down] - step, -1)
        passed = (reach < 0) | (into[np.maximum(reach, 0)] < values[down])
        low[down] = reach + 1
        down = down[~passed]
        high[down] = low[down]
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = into[middle] < values[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two tokenizations of the same bytes.

    Returns, for each group, how many tokens of A and of B end with it or before, and for each link
    its A token and its B token, in order of A (or of B, if B has fewer tokens), then of the other.
    """
    if len(ends_b) < len(ends_a):
        b, a, of_b, of_a = overlaps(ends_b, ends_a)
        return a, b, of_a, of_b
    rank = gallop(ends_a, ends_b)
    common = ends_b[np.minimum(rank, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(len(ends_a), dtype=bool)
    cut = np.flatnonzero(common)
    first = np.concatenate([[0], (rank + common)[:-1]]) if len(rank) else rank
    count = rank - first + 1
    of_a = np.repeat(np.arange(len(ends_a)), count)
    of_b = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return cut + 1, rank[cut] + 1, of_a, of_b


# -- tokenizers -----------------------------------------------------------------


def _byte_level() -> dict[str, int]:
    """The byte behind each printable character of a byte-level vocabulary (GPT-2's public rule)."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library; every text is encoded behind one space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        back = _byte_level()
        size = self.encoder.get_vocab_size(with_added_tokens=True)
        self.bytes = [self._entry(self.encoder.id_to_token(i), back) for i in range(size)]

    @staticmethod
    def _entry(token: str | None, back: dict[str, int]) -> bytes:
        return b"".join(bytes([back[c]]) if c in back else c.encode() for c in token or "")

    def ids(self, text: str) -> list[int]:
        return self.encoder.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """A SentencePiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces that go over a marker cannot be encoded by chunks")
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]

    def ids(self, text: str) -> list[int]:
        return self.encoder.encode(text)


class ChunkTable:
    """Aligned chunks: numbers of tokens and groups, the groups as text, and the linked id pairs.

    A pair is one number, ``a * base + b``.  A chunk whose tokens do not spell it has -1 groups.
    """

    def __init__(self, a: ByteLevel, b: Pieces, settings: Settings):
        self.a, self.b, self.settings, self.base = a, b, settings, len(b.bytes)
        self.length_a = np.array([len(x) for x in a.bytes], dtype=np.int64)
        self.length_b = np.array([len(x) for x in b.bytes], dtype=np.int64)
        # how ids are written within a group and at its end
        written = [f"{i}{end}" for n, ends in ((len(a.bytes), ",|"), (len(b.bytes), ",;")) for end in ends for i in range(n)]
        self.written = np.array(written, dtype=object)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 3), dtype=np.int64)
        self.offset, self.pairs = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, chunks: Iterable[str]) -> None:
        """Align the chunks that are not held yet; the table begins anew when it would be too full."""
        new = list(set(chunks).difference(self.place))
        counts, pairs = [self.counts], [self.pairs]
        sizes: list[np.ndarray] = []
        start = 0
        while start < len(new):
            end, held = start, 0
            while end < len(new) and (end == start or held + len(new[end]) < self.settings.joined):
                held += len(new[end]) + 1
                end += 1
            for made in self._aligned(new[start:end]):
                counts.append(made[0])
                self.groups += made[1]
                sizes.append(made[2])
                pairs.append(made[3])
            start = end
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.counts = np.concatenate(counts)
        self.pairs = np.concatenate(pairs)
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(np.concatenate([[0], *sizes])[1:], dtype=np.int64)])

    def _aligned(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]]:
        """Counts, groups, numbers of pairs and pairs of chunks, all in one search where that holds."""
        one = len(chunks) == 1
        # a chunk that ends in white space may meet the next one's; a marker is no space
        if not one and any(c[-1:].isspace() or MARK in c for c in chunks):
            odd = [c[-1:].isspace() or MARK in c for c in chunks]
            start = 0
            for end in range(1, len(chunks) + 1):
                if end == len(chunks) or odd[end] or odd[start]:
                    yield from self._aligned(chunks[start:end])
                    start = end
            return
        joined = " ".join(chunks)
        plain = (" " + joined).encode("utf-8", "surrogatepass")
        a, b = self.a.ids(joined), self.b.ids(joined)
        whole = plain == b"".join([self.a.bytes[i] for i in a]) and plain == b"".join([self.b.bytes[i] for i in b])
        if not joined or not whole:
            if one:
                yield np.array([[0, 0, -1]]), [""], np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
            else:
                half = len(chunks) // 2
                yield from self._aligned(chunks[:half])
                yield from self._aligned(chunks[half:])
            return
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a = np.cumsum(self.length_a[ids_a])
        cut_a, cut_b, of_a, of_b = overlaps(ends_a, np.cumsum(self.length_b[ids_b]))
        # chunks end where both tokenizations end a token
        chunk_end = np.cumsum([len(c.encode("utf-8", "surrogatepass")) + 1 for c in chunks])
        group_end = ends_a[cut_a - 1]
        last = np.searchsorted(group_end, chunk_end)
        assert np.array_equal(group_end[last], chunk_end), "a token goes over a chunk"
        n_a, n_b, n_groups = (np.diff(x, prepend=0) for x in (cut_a[last], cut_b[last], last + 1))
        texts = self._texts(ids_a, ids_b, cut_a, cut_b, last)
        order = np.argsort(of_a, kind="stable")
        pairs = (ids_a[of_a] * self.base + ids_b[of_b])[order]
        sizes = np.diff(np.searchsorted(of_a[order], cut_a[last]), prepend=0)
        yield np.stack([n_a, n_b, n_groups], axis=1), texts, sizes, pairs

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, last: np.ndarray) -> list[str]:
        """The groups of each chunk: ids of A, then those of B, each written with what follows it."""
        n_a, n_b = len(self.length_a), len(self.length_b)
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        place_a = np.arange(len(ids_a)) + np.repeat(cut_b - size_b, size_a)
        place_b = np.arange(len(ids_b)) + np.repeat(cut_a, size_b)
        end_a, end_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        end_a[cut_a - 1] = n_a
        end_b[cut_b - 1] = n_b
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        order[place_a], order[place_b] = ids_a + end_a, ids_b + end_b + 2 * n_a
        parts = self.written[order].tolist()
        bounds = [0, *(cut_a[last] + cut_b[last]).tolist()]
        return ["".join(parts[x:y])[:-1] for x, y in zip(bounds, bounds[1:])]


def chunks_of(text: str) -> list[str]:
    """The text cut at spaces that no token of either tokenizer goes over."""
    return _BORDER.split(text)


def _table(path_a: str, path_b: str, settings: Settings) -> ChunkTable:
    key = f"alignment {path_a} {path_b} {settings}"
    return per_process(key, lambda: ChunkTable(ByteLevel(path_a), Pieces(path_b), settings))


def _rows(texts: list[str], table: ChunkTable) -> tuple[list[np.ndarray], list[str], list[np.ndarray], list[np.ndarray]]:
    """Counts, groups, distinct pairs (rising) and how often each is linked, of each text."""
    split = [chunks_of(t) if t else [] for t in texts]
    wanted: set[str] = set()
    for chunks in split:
        wanted.update(chunks)
    if len(table.place) + len(wanted) > table.settings.table:
        table.clear()
    table.add(wanted)
    number, groups_of = table.place, table.groups
    counts, groups, pairs, times = [], [], [], []
    for chunks in split:
        at = np.fromiter(map(number.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        own = table.counts[at]
        if not len(at) or (own[:, 2] < 0).any():
            counts.append(np.zeros(3, dtype=np.int64))
            groups.append("")
            pairs.append(np.zeros(0, dtype=np.int64))
            times.append(np.zeros(0, dtype=np.int64))
            continue
        counts.append(own.sum(axis=0))
        groups.append(";".join([groups_of[i] for i in at.tolist()]))
        distinct, often = np.unique(at, return_counts=True)
        size = table.offset[distinct + 1] - table.offset[distinct]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        every = table.pairs[inside + np.repeat(table.offset[distinct], size)]
        order = np.argsort(every, kind="stable")
        every, weight = every[order], np.repeat(often, size)[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        pairs.append(every[first])
        times.append(np.add.reduceat(weight, first))
    return counts, groups, pairs, times


def _packed(values: np.ndarray) -> bytes:
    """Rising numbers as differences, which the Parquet codec makes small."""
    return np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", settings: Settings = PRODUCTION) -> DataFrame:
    """``docs`` without ``text``, with ``n_a, n_b, n_groups, n_links`` (long), ``groups`` (string),
    ``pairs`` and ``times`` (binary) behind its other columns; names that clash get an underscore.

    A text is encoded by tokenizer A behind one space and by tokenizer B, which adds it.  ``groups``
    has decimal ids, ``a1,a2|b1;a3|b2``; ``pairs`` are the distinct linked pairs and ``times`` how
    often each is linked.  Texts that are null or empty, or that the tokens of one side do not spell,
    have no tokens: zeros and empty values.  No shuffle; one row out per row in.
    """
    names = free_names(docs.drop(text), "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
    kinds = [T.LongType()] * 4 + [T.StringType(), T.BinaryType(), T.BinaryType()]
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path_a, path_b, settings)
        for batch in pieces_of(batches, text, 2 << 20):
            counts, groups, pairs, times = _rows(batch.column(text).to_pylist(), table)
            n = np.stack(counts)
            columns = [pa.array(n[:, k]) for k in range(3)] + [pa.array(np.where(n[:, 2] > 0, n[:, 0] + n[:, 1] - n[:, 2], 0))]
            columns += [pa.array(groups, pa.string())]
            columns += [pa.array([_packed(x) for x in pairs], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in times], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), *names])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


# -- counts over the corpus -----------------------------------------------------


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: in how many rows each pair of ids is linked.  Tasks add up before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, waiting = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([held, *waiting])
            weight = np.concatenate([sums, np.ones(len(every) - len(held), dtype=np.int64)])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
            return every[first], np.add.reduceat(weight, first) if len(first) else weight

        for batch in batches:
            waiting += [_unpacked(x) for x in batch.column("pairs").to_pylist() if x]
            if sum(map(len, waiting)) > 2_000_000:
                (held, sums), waiting = merge(), []
                if len(held) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], ["pair", "n"])
                    held, sums = held[:0], sums[:0]
        held, sums = merge()
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], ["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, base: int, settings: Settings = PRODUCTION) -> DataFrame:
    """``aligned`` (cut before: it is read several times) without ``pairs`` and ``times``, with
    ``n_best`` and ``count_sum``: links whose pair is in as many rows as any pair of its A id, and
    the sum over the links of the rows their pairs are in.  ``base``: number of ids of B.

    The table of pairs is bounded by the two vocabularies.  It goes to the tasks in slices of
    ``slice_pairs``; with more than one slice the rows' sums over the slices are added up.
    """
    spark = aligned.sparkSession
    folder = new_folder(spark, "alignment")
    counts = pair_counts(aligned).withColumn("a", F.floor(F.col("pair") / base).cast("long"))
    counts.write.option("compression", "zstd").parquet(f"{folder}/pairs")
    counts = spark.read.parquet(f"{folder}/pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    judged = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    slices = max(1, -(-counts.count() // settings.slice_pairs))
    row, n_best, count_sum = free_names(aligned, "row__", "n_best", "count_sum")
    others = [c for c in aligned.columns if c not in ("pairs", "times")]
    if slices == 1:
        return _summed(aligned, judged, n_best, count_sum)
    numbered = aligned.withColumn(row, F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(f"{folder}/rows")
    numbered = spark.read.parquet(f"{folder}/rows")
    sums = None
    for k in range(slices):
        own = judged.filter(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k)
        part = _summed(numbered.select(row, "pairs", "times"), own, n_best, count_sum)
        sums = part if sums is None else sums.unionByName(part)
    total = sums.groupBy(row).agg(F.sum(n_best).alias(n_best), F.sum(count_sum).alias(count_sum))
    return numbered.select(row, *others).join(total, row).drop(row)


def _summed(aligned: DataFrame, judged: DataFrame, n_best: str, count_sum: str) -> DataFrame:
    """Sums over the pairs in ``judged``, a slice of bounded size that goes to every task."""
    table = judged.orderBy("pair").toArrow().combine_chunks()
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    schema = T.StructType([*kept, T.StructField(n_best, T.LongType()), T.StructField(count_sum, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            bests, sums = [], []
            for packed, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                if not packed or not len(pair):
                    bests.append(0)
                    sums.append(0)
                    continue
                own, often = _unpacked(packed), np.frombuffer(times, dtype="<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
                often = np.where(pair[at] == own, often, 0)
                bests.append(int(often[best[at]].sum()))
                sums.append(int((often * n[at]).sum()))
            columns = [*(batch.column(f.name) for f in kept), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return aligned.mapInArrow(run, schema)


def base_of(path_b: str) -> int:
    """Number of ids of a SentencePiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
