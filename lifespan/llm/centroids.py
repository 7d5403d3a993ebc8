"""Language by the nearest of several centroids, with rejection by distance.

A text becomes a vector of hashed byte n-grams of its letters, weighed by TF-IDF and normalised.
Each language has a few centroids from spherical k-means; the nearest by cosine names the
language, and a text farther from it than (almost) all texts it was learned from is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lifespan.llm.common import cut, free_names, pieces_of
from lifespan.llm.words import text_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the fitted sample are part of the method: rows per language, and in all."""

    dimensions: int = 1 << 13
    lengths: tuple[int, ...] = (1, 2, 3, 4)
    per_language: int = 400
    sample: int = 8000
    centroids: int = 4
    rounds: int = 10
    quantile: float = 0.995


PRODUCTION = Settings()
#: Groups in which the smallest hashes of a language are looked for before they meet.
SHARES = 64
_FOLD = np.zeros(256, dtype=np.uint32)
_FOLD[ord("a") : ord("z") + 1] = np.arange(1, 27)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_FOLD[128:] = np.arange(27, 155)


def counts(texts: pa.Array, settings: Settings = PRODUCTION) -> np.ndarray:
    """n-gram counts, a row per text (null: zeros), over the letters and gaps of the whole text."""
    data, bounds = text_bytes(texts)
    n_rows, dims = len(bounds) - 1, settings.dimensions
    # a gap on either side of every text, so that n-grams neither cross texts nor miss their edges
    length = np.diff(bounds)
    begin = bounds[:-1] + np.arange(n_rows) * 2 + 1
    stream = np.zeros(len(data) + 2 * n_rows, dtype=np.uint32)
    inside = np.repeat(begin - bounds[:-1], length) + np.arange(len(data))
    stream[inside] = _FOLD[data]
    row = np.repeat(np.arange(n_rows, dtype=np.int64), length + 2) * dims
    out = np.zeros(n_rows * dims, dtype=np.int64)
    value = np.zeros(len(stream), dtype=np.uint32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for n in range(1, max(settings.lengths) + 1):
        value = value[: len(stream) - n + 1] * np.uint32(155) + stream[n - 1 :]
        if n in settings.lengths:
            last = row[n - 1 :]
            whole = (row[: len(last)] == last) & (stream[: len(last)] + stream[n - 1 :] > 0)
            slot = ((value + np.uint32(n)) * np.uint32(2654435761)) >> shift
            out += np.bincount(last[whole] + slot[whole], minlength=n_rows * dims)
    return out.reshape(n_rows, dims)


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    """``centre[i]`` belongs to ``language[i]``; a cosine below ``least[i]`` is rejected."""

    idf: np.ndarray
    centre: np.ndarray
    language: list[str]
    least: np.ndarray
    settings: Settings

    def vectors(self, found: np.ndarray) -> np.ndarray:
        return unit(np.log1p(found).astype(np.float32) * self.idf)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it was rejected."""
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], dtype=bool)
        if not self.language or not len(lettered):
            return [UNKNOWN] * len(lettered), np.zeros(len(lettered)), np.ones(len(lettered), dtype=bool)
        near = self.vectors(counts(texts, self.settings)) @ self.centre.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(best)), best], 0, 1).astype(float)
        names = [self.language[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0), ~lettered | (score < self.least[best])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(train: DataFrame, settings: Settings = PRODUCTION) -> Model:
    """Learn from ``text`` and ``lang`` of the given rows; null languages and texts are left out.

    Document frequencies come from all rows.  Centroids come from a sample that is bounded by
    ``per_language`` and ``sample``: of each language the distinct texts with the smallest hashes.
    Each task keeps so many hashes of a language, then each of ``SHARES`` groups, then one task;
    texts are read for those that are left.
    """
    rows = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("draw"))
    dims = settings.dimensions

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, dtype=np.int64), 0
        for batch in pieces_of(batches, "text", 1 << 20):
            total += (counts(batch.column("text"), settings) > 0).sum(axis=0)
            n += batch.num_rows
        slots = np.concatenate([np.flatnonzero(total), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.concatenate([total[slots[:-1]], [n]]))], ["slot", "n"])

    found = rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = {r["slot"]: r["n"] for r in found}
    n_rows = seen.pop(-1, 0)
    df = np.zeros(dims)
    df[list(seen)] = list(seen.values())
    idf = (np.log((1 + n_rows) / (1 + df)) + 1).astype(np.float32)

    drawn = rows.select("lang", "draw").mapInArrow(_least(settings.per_language), T.StructType([rows.schema["lang"], T.StructField("draw", T.LongType())]))
    share = Window.partitionBy("lang", F.pmod("draw", F.lit(SHARES)))
    few = drawn.distinct().withColumn("place", F.row_number().over(share.orderBy("draw"))).filter(F.col("place") <= settings.per_language)
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("place") <= settings.per_language)
    # at most ``sample`` rows in all
    chosen = cut(chosen.orderBy("place", "lang").limit(settings.sample))
    sampled = rows.join(F.broadcast(chosen), ["lang", "draw"]).groupBy("lang", "place").agg(F.min("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1 << 20):
            table = counts(batch.column("text"), settings)
            at = [np.flatnonzero(r) for r in table]
            packed = [np.stack([i, r[i]]).astype("<i4").tobytes() for i, r in zip(at, table)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(packed, pa.binary())], ["lang", "place", "v"])

    packed = sampled.select("lang", "place", "text").mapInArrow(sparse, T.StructType([rows.schema["lang"], T.StructField("place", T.IntegerType()), T.StructField("v", T.BinaryType())]))
    sample = packed.orderBy("place", "lang").collect()
    centres, names, least = [], [], []
    model = Model(idf, np.zeros((0, dims), np.float32), [], np.zeros(0), settings)
    for language in sorted({r.lang for r in sample}):
        packed = [np.frombuffer(r.v, "<i4").reshape(2, -1) for r in sample if r.lang == language]
        table = np.zeros((len(packed), dims), dtype=np.int64)
        for i, (slots, values) in enumerate(packed):
            table[i, slots] = values
        for centre, near in _clusters(model.vectors(table), settings):
            centres.append(centre)
            names.append(language)
            least.append(np.quantile(near, 1 - settings.quantile))
    if names:
        model = Model(idf, np.stack(centres).astype(np.float32), names, np.array(least), settings)
    return model


def _least(n: int):
    """The ``n`` smallest distinct hashes of each language among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            draw = batch.column("draw").to_numpy()
            found = batch.column("lang").dictionary_encode()
            code = found.indices.to_numpy()
            for k, lang in enumerate(found.dictionary.to_pylist()):
                held[lang] = np.unique(np.concatenate([held.get(lang, draw[:0]), draw[code == k]]))[:n]
        for lang, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values)], ["lang", "draw"])

    return run


def _clusters(x: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spherical k-means from far-apart starts: centroid, and the cosines of its members."""
    start = [int((x @ unit(x.sum(axis=0, keepdims=True)).T).argmax())]
    while len(start) < min(settings.centroids, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    centre = x[start]
    for _ in range(settings.rounds):
        own = (x @ centre.T).argmax(axis=1)
        used = np.unique(own)
        centre = unit(np.stack([x[own == c].sum(axis=0) for c in used]))
    near = x @ centre.T
    own = near.argmax(axis=1)
    for c in np.unique(own):
        yield centre[c], near[own == c, c]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, rejected.  Columns of the same
    names stay; the new ones then get an underscore.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    names = free_names(docs, "lang_pred", "score", "rejected")
    kinds = [T.StringType(), T.DoubleType(), T.BooleanType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text, 1 << 20):
            language, score, rejected = model.predict(batch.column(text))
            columns = [pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), *names])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(names, kinds))]))
