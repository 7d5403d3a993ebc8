"""Repeated passages by FM-indexes over shards of the corpus.

A window of 13 words can only equal one with the same anchor, the run of five words in it with the
least hash.  Documents whose whole sequence of words stands in a smaller document need no search: all of it
goes.  Of the others, anchors that stand in one document alone are left out, and the windows of the others
go to shards by anchor, as segments: runs of windows with one anchor.  Each shard builds an
FM-index of its distinct segments (Burrows-Wheeler transform in a wavelet matrix of packed bits)
and streams them through it.  Backward search gives the matching statistics of every window; where
they reach 13 words, the range of suffixes gives the smallest document that holds the window.

Words are compared by their 64-bit hashes, and a segment travels as the hashes of its words.

An anchor that many documents hold would gather too much in one shard, so its windows are dealt out
one by one, by their own hash.  A sample finds those of half a per cent of all documents or more,
which are not even counted; the others are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifespan.llm.common import cut, partitions_of, pieces_of
from lifespan.llm.words import Words, hashes, mixed, runs, split

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """``sample`` rows at most (about) look for common anchors; ``common`` of them make one common.
    ``deal`` documents that hold an anchor make its windows go one by one."""

    window: int = 13
    anchor: int = 5
    shard_words: int = 400_000
    sample: int = 3000
    common: int = 15
    deal: int = 20_000


PRODUCTION = Settings()
SLICE = 2 << 20


# -- the index ------------------------------------------------------------------


class WaveletMatrix:
    """A sequence of numbers as one packed bit vector per bit, with counts before each word."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.levels = len(values), []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            packed = np.zeros((self.n // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            zeros = self.n - int(ones.sum())
            self.levels.append((bit, words, before, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])
        self.first = self._down(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, words, before, zeros in self.levels:
            word = at >> 6
            below = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
            ones = before[word] + np.bitwise_count(words[word] & below)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """Backward search for patterns of up to 16 symbols; symbol 0 separates texts."""

    def __init__(self, text: np.ndarray):
        self.n, top = len(text), int(text.max(initial=0))
        rank = text.astype(np.int64)
        suffixes = np.arange(self.n)
        for reach in (1, 2, 4, 8):
            ahead = np.zeros(self.n, dtype=np.int64)
            ahead[: max(0, self.n - reach)] = rank[reach:] + 1
            key = rank * (int(ahead.max(initial=0)) + 1) + ahead
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            rank = np.empty(self.n, dtype=np.int64)
            rank[suffixes] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        self.suffixes = suffixes
        self.wavelet = WaveletMatrix(text[suffixes - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes after one more symbol in front."""
        start = self.before[symbol]
        return start + self.wavelet.rank(symbol, low), start + self.wavelet.rank(symbol, high)


def matches(index: FMIndex, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows ``text[start : start + length]`` that stand in the index more than once: their numbers
    in ``starts`` and suffix ranges.  A search ends as soon as only the window itself is left."""
    going = np.arange(len(starts))
    low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), index.n, dtype=np.int64)
    for back in range(length - 1, -1, -1):
        low, high = index.extend(text[starts[going] + back], low, high)
        more = high - low > 1
        going, low, high = going[more], low[more], high[more]
    return going, low, high


def least_documents(words: np.ndarray, counts: np.ndarray, document: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the smallest document that has it, and windows per segment.

    ``words`` are the hashes of the words of all (distinct) segments, ``counts`` their numbers,
    ``document`` the smallest document of each whole segment.
    """
    _, symbol = np.unique(words, return_inverse=True)
    row = np.repeat(np.arange(len(counts)), counts)
    text = np.zeros(len(symbol) + len(counts), dtype=np.int64)
    text[np.arange(len(symbol)) + row] = symbol + 1
    begin = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
    windows = np.maximum(counts - length + 1, 0)
    offset = np.concatenate([[0], np.cumsum(windows)])
    starts = np.arange(offset[-1]) - np.repeat(offset[:-1], windows) + np.repeat(begin, windows)
    least = np.repeat(document, windows)
    index = FMIndex(text)
    found, low, high = matches(index, text, starts, length)
    if len(found):
        owner = np.repeat(document, counts + 1)[index.suffixes]
        bounds, which = np.unique(low * np.int64(index.n + 1) + high, return_inverse=True)
        ranges = np.stack([bounds // (index.n + 1), bounds % (index.n + 1)], axis=1)
        smallest = np.minimum.reduceat(np.append(owner, np.iinfo(np.int64).max), ranges.ravel())[::2]
        least[found] = smallest[which]
    return least, windows


# -- anchors and segments -------------------------------------------------------


def anchors(w: Words, value: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of one text: its first word, its anchor's first word, and the anchor's hash."""
    grams = runs(value, settings.anchor)
    n = len(w.row) - settings.window + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    wide = settings.window - settings.anchor + 1
    least, place = grams[:n].copy(), np.arange(n)
    for k in range(1, wide):
        lower = grams[k : k + n] < least
        least = np.where(lower, grams[k : k + n], least)
        place = np.where(lower, np.arange(k, k + n), place)
    start = np.flatnonzero(w.row[:n] == w.row[settings.window - 1 :])
    return start, place[start], least[start]


def _anchored(texts: pa.Array, settings: Settings):
    w = split(texts)
    value = hashes(w)
    return w, value, *anchors(w, value, settings)


def _pairs(docs: DataFrame, settings: Settings, skip: np.ndarray) -> DataFrame:
    """Distinct ``anchor, doc_id`` but for the anchors to skip (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", SLICE):
            w, _, start, _, anchor = _anchored(batch.column("text"), settings)
            row = w.row[start]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, dtype=bool)
            anchor, row = anchor[new].view(np.int64), row[new]
            fresh = ~np.isin(anchor, skip)
            order = np.lexsort((row[fresh], anchor[fresh]))
            anchor, row = anchor[fresh][order], row[fresh][order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, dtype=bool)
            ids = batch.column("doc_id").to_numpy()[row[new]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(ids)], ["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


def common_anchors(docs: DataFrame, whole: DataFrame, settings: Settings) -> np.ndarray:
    """Anchors found in many documents of a bounded sample, copies (``whole``) left out, sorted."""
    n = docs.count()
    share = min(1.0, settings.sample / max(1, n))
    # drawn by id before anything else, so that only the sample is moved
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.withColumn("print", F.xxhash64("text")).join(whole, ["doc_id", "print"], "left_anti")
    counted = _pairs(drawn, settings, np.zeros(0, dtype=np.int64)).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    return np.sort(np.array([r["anchor"] for r in counted.filter(F.col("n") >= settings.common).collect()], dtype=np.int64))


def _shared(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Those of ``anchor, doc_id`` whose anchor stands in two documents or more, and ``many``: whether
    it stands in more than ``deal``.  A task holds that many rows of an anchor until it knows."""
    n = partitions_of(pairs.sparkSession)
    ordered = pairs.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(anchor: np.ndarray, ids: np.ndarray, many: bool | np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(anchor), pa.array(ids), pa.array(np.broadcast_to(many, len(anchor)).copy())]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "many"])

        # the last anchor so far: its rows, or only that it has been found to stand in many documents
        last, held, many = None, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, ids = batch.column("anchor").to_numpy(), batch.column("doc_id").to_numpy()
            own = int(np.searchsorted(anchor, last, side="right")) if last is not None and anchor[0] == last else 0
            if many and own:
                yield rows(anchor[:own], ids[:own], True)
                anchor, ids = anchor[own:], ids[own:]
            elif held:
                before = np.concatenate(held)
                anchor, ids = np.concatenate([np.full(len(before), last), anchor]), np.concatenate([before, ids])
            if not len(anchor):
                continue
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(first, len(anchor)))
            # the last anchor may go on in the next batch
            done = first[-1]
            keep = np.repeat(ids[first] != ids[first + size - 1], size)[:done]
            large = np.repeat(size > settings.deal, size)[:done]
            yield rows(anchor[:done][keep], ids[:done][keep], large[keep])
            last, held, many = anchor[-1], [ids[done:]], bool(size[-1] > settings.deal)
            if many:
                yield rows(anchor[done:], ids[done:], True)
                held = []
        if held and held[0][0] != held[0][-1]:
            yield rows(np.full(len(held[0]), last), held[0], False)

    return ordered.mapInArrow(run, "anchor long, doc_id long, many boolean")


@dataclass
class Segments:
    """Runs of windows with one anchor in one place: row, key, first word in the text, hash of the
    word sequence; and the words' hashes, one segment behind the other."""

    row: np.ndarray
    key: np.ndarray
    first: np.ndarray
    digest: np.ndarray
    size: np.ndarray
    words: np.ndarray


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _segments(batch: pa.RecordBatch, common: np.ndarray, settings: Settings) -> Segments | None:
    """Every segment of windows with wanted (``anchors``) or common anchors; those of an anchor that
    many documents hold (``many``) are single windows with keys of their own."""
    w, value, start, place, anchor = _anchored(batch.column("text"), settings)
    row, anchor = w.row[start], anchor.view(np.int64)
    bounds = np.searchsorted(row, np.arange(w.n_rows + 1))
    single = np.isin(anchor, common)
    chosen = single.copy()
    for name, into in (("anchors", chosen), ("many", single)):
        lists = batch.column(name)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for r in np.flatnonzero(np.diff(ends) > 0):
            at = slice(bounds[r], bounds[r + 1])
            into[at] |= np.isin(anchor[at], flat[ends[r] : ends[r + 1]])
    at = np.flatnonzero(chosen)
    if not len(at):
        return None
    # a segment goes on while the next window has the same anchor in the same place
    begins = np.concatenate([[True], (place[at[1:]] != place[at[:-1]]) | (row[at[1:]] != row[at[:-1]]) | single[at[1:]]])
    head = np.flatnonzero(begins)
    size = np.diff(np.append(head, len(at))) - 1 + settings.window
    head = at[head]
    begin, within = start[head], _within(size)
    words = value[within + np.repeat(begin, size)]
    digest = np.add.reduceat(mixed(words + mixed(within.astype(np.uint64) + _U(1))), np.cumsum(size) - size).view(np.int64)
    # the digest of a single window is also the key that deals it out
    return Segments(row[head], np.where(single[head], digest, anchor[head]), begin - w.bounds()[row[head]], digest, size, words)


def _binary(words: np.ndarray, size: np.ndarray) -> pa.Array:
    """One binary value for each segment, 8 bytes a word."""
    ends = np.concatenate([[0], np.cumsum(size) * 8])
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
    data = words.tobytes()
    return pa.array([data[x:y] for x, y in zip(ends, ends[1:])], pa.binary())


def _distinct(joined: DataFrame, common: np.ndarray, settings: Settings) -> DataFrame:
    """``key, digest, segment, doc_id`` (the smallest) and ``n`` (how often), combined within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found: list[tuple[Segments, np.ndarray]] = []
            for batch in pieces_of([whole], "text", SLICE):
                made = _segments(batch, common, settings)
                if made is not None:
                    found.append((made, batch.column("doc_id").to_numpy()[made.row]))
            if not found:
                continue
            key, digest, size = (np.concatenate([getattr(f, x) for f, _ in found]) for x in ("key", "digest", "size"))
            ids = np.concatenate([d for _, d in found])
            order = np.lexsort((ids, digest, key))
            new = np.concatenate([[True], (key[order[1:]] != key[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])])
            first = np.flatnonzero(new)
            kept, n = order[first], np.diff(np.append(first, len(order)))
            words = np.concatenate([f.words for f, _ in found])
            begin = np.cumsum(size) - size
            own = size[kept]
            words = words[_within(own) + np.repeat(begin[kept], own)]
            columns = [pa.array(key[kept]), pa.array(digest[kept]), _binary(words, own), pa.array(ids[kept]), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "segment", "doc_id", "n"])

    return joined.mapInArrow(run, "key long, digest long, segment binary, doc_id long, n long")


def _searched(segments: DataFrame, settings: Settings) -> DataFrame:
    """``key, digest, least``: the smallest document of each window of a segment, where it matters."""
    n = partitions_of(segments.sparkSession)
    placed = segments.repartition(n, "key").sortWithinPartitions("key", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words, limit = 0, settings.shard_words
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            words += batch.column("segment").nbytes // 8
            if words < limit:
                continue
            # shards end between two keys
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = table.column("key").to_numpy()
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield _shard(table.slice(0, done), settings)
            rest = table.slice(done)
            held, words = [rest], rest.column("segment").nbytes // 8
            limit = max(settings.shard_words, 2 * words)
        if held:
            yield _shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0], settings)

    return placed.mapInArrow(run, "key long, digest long, least array<long>")


def _shard(rows: pa.RecordBatch, settings: Settings) -> pa.RecordBatch:
    key, digest, ids, n = (rows.column(c).to_numpy() for c in ("key", "digest", "doc_id", "n"))
    # rows of one segment from several batches are one
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]))
    own, count = np.minimum.reduceat(ids, first), np.add.reduceat(n, first)
    segments = rows.column("segment").take(pa.array(first)).to_pylist()
    size = np.array([len(x) // 8 for x in segments])
    least, windows = least_documents(np.frombuffer(b"".join(segments), dtype="<u8"), size, own, settings.window)
    # a segment of one document in which nothing stands in a smaller one removes nothing
    begin = np.cumsum(windows) - windows
    use = (count > 1) | np.logical_or.reduceat(least < np.repeat(own, windows), begin)
    kept = np.repeat(use, windows)
    ends = np.concatenate([[0], np.cumsum(windows[use])]).astype(np.int32)
    columns = [pa.array(key[first][use]), pa.array(digest[first][use]), pa.ListArray.from_arrays(pa.array(ends), pa.array(least[kept]))]
    return pa.RecordBatch.from_arrays(columns, ["key", "digest", "least"])


def _occurrences(joined: DataFrame, common: np.ndarray, settings: Settings) -> DataFrame:
    """``key, digest, doc_id, mark, first``: where the segments stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", SLICE):
            made = _segments(batch, common, settings)
            if made is not None:
                at = pa.array(made.row)
                columns = [pa.array(made.key), pa.array(made.digest), batch.column("doc_id").take(at), batch.column("mark").take(at)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made.first.astype(np.int32))], ["key", "digest", "doc_id", "mark", "first"])

    return joined.mapInArrow(run, "key long, digest long, doc_id long, mark int, first int")


def _mark() -> Column:
    """Upper half of the hash of the text."""
    return F.shiftright(F.xxhash64("text"), 32).cast("int")


def copies(docs: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """``doc_id, print`` (hash of the text), ``n_words`` of the rows whose whole sequence of words,
    a window or longer, also makes up a document with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", SLICE):
            w = split(batch.column("text"))
            counts = w.counts()
            long = np.flatnonzero(counts >= settings.window)
            if not len(long):
                continue
            value, begin = hashes(w), w.bounds()
            # each word with its place: sums of them tell sequences apart, in two lanes
            place = (np.arange(len(value)) - np.repeat(begin[:-1], counts)).astype(np.uint64)
            chosen = np.isin(w.row, long)
            first = np.concatenate([[0], np.cumsum(counts[long])[:-1]])
            lanes = [np.add.reduceat(mixed(value + mixed(place + _U(k)))[chosen], first).view(np.int64) for k in (1, 1 << 40)]
            columns = [batch.column("doc_id").take(pa.array(long)), batch.column("print").take(pa.array(long)), pa.array(counts[long])]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, lanes)], ["doc_id", "print", "n_words", "a", "b"])

    schema = "doc_id long, print long, n_words long, a long, b long"
    digests = cut(docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(run, schema))
    same = ["a", "b", "n_words"]
    first = digests.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = cut(first.filter("first < last"))
    # groups of more than a thousandth of all rows, a thousand at most, come to their rows
    large = F.broadcast(first.filter(F.col("n") > digests.count() / 1000).select(*same, "first"))
    found = digests.join(large, same).unionByName(digests.join(large, same, "left_anti").join(first.select(*same, "first"), same))
    return cut(found.filter("first < doc_id").select("doc_id", "print", "n_words"))


def repeated_windows(docs: DataFrame, common: np.ndarray, settings: Settings = PRODUCTION) -> DataFrame:
    """``doc_id, starts``: first words of the windows that also start in a smaller document, each
    behind 32 bits of the hash of the text.

    ``docs`` has ``doc_id`` (long, not null) and ``text``; ``common`` are anchors known to be repeated.
    Documents without such windows have no row.
    """
    shared = _shared(_pairs(docs, settings, common), settings)
    lists = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("many"))
    # texts meet the lists, and later what is removed, by one exchange on their id
    joined = docs.join(lists.withColumnRenamed("doc_id", "owner"), F.col("doc_id") == F.col("owner"), "left")
    none = F.array().cast("array<long>")
    joined = joined.select("doc_id", "text", F.coalesce("anchors", none).alias("anchors"), F.coalesce("many", none).alias("many"), _mark().alias("mark"))
    found = _searched(_distinct(joined, common, settings), settings)
    places = _occurrences(joined, common, settings)
    # ids may be repeated: 32 bits of the text's hash say which row a start belongs to
    start = lambda i: F.shiftleft(F.col("mark").cast("long"), 32).bitwiseOR((F.col("first") + i).cast("long"))
    starts = F.filter(F.transform("least", lambda d, i: F.when(d < F.col("doc_id"), start(i))), lambda x: x.isNotNull())
    removed = places.join(found, ["key", "digest"]).select("doc_id", starts.alias("starts")).filter(F.size("starts") > 0)
    return removed.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, settings: Settings = PRODUCTION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept``, the kept words joined by one space.

    A word is removed if a window of 13 words covers it whose words also start in a document with a
    smaller id; windows are judged on the input.  Null text has no words; rows without an id are
    neither larger nor smaller than others, and repeated ids are not smaller than each other.
    """
    # columns that are right as they are keep their identity: only then is the exchange of texts shared
    fits = key == "doc_id" and text == "text" and docs.schema[key].dataType == T.LongType()
    chosen = docs.select("doc_id", "text") if fits else docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = chosen.filter(F.col("doc_id").isNotNull())
    whole = copies(named, settings)
    prints = whole.groupBy(F.col("doc_id").alias("copy_id")).agg(F.collect_set("print").alias("prints"))
    # ids may be repeated, so a copy is known by its id and its text
    own = named.join(prints, F.col("doc_id") == F.col("copy_id"), "left")
    own = own.filter(F.col("prints").isNull() | ~F.array_contains("prints", F.xxhash64("text"))).select("doc_id", "text")
    found = repeated_windows(own, common_anchors(named, whole, settings), settings)
    matched = own.join(found.withColumnRenamed("doc_id", "owner"), F.col("doc_id") == F.col("owner"), "left").select("doc_id", "text", "starts", _mark().alias("mark"))
    nameless = chosen.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<long>").alias("starts"), F.lit(0).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for t, s, m in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "mark"))):
                words = (t or "").encode().split()
                n_words.append(len(words))
                gone = 0
                if s:
                    # +1 where a window begins and -1 behind it: positive sums are covered
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(np.array(s))
                    at = at[at >> 32 == m] & 0xFFFFFFFF
                    change[at] += 1
                    change[at + settings.window] -= 1
                    covered = np.cumsum(change[:-1]) > 0
                    gone = int(covered.sum())
                    words = [x for x, c in zip(words, covered.tolist()) if not c]
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string")
    gone = whole.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    return matched.unionByName(nameless).mapInArrow(run, schema).unionByName(gone)
