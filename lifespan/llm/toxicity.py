"""Toxicity by a learned lexicon: a trie, met by Levenshtein automata, and the window around each hit.

The lexicon comes from labelled documents: words, and stems that several words begin with, found
almost only in documents labelled 1.  Its trie and the automata of a bounded number of edits are
run together: a state is the set of ``(trie node, edits, letter owed by a swap)`` that the letters
read so far can reach.  States are made when first needed, so a word costs one step per letter and
most words end after a few.  A spelling near an entry that is common in clean documents is no hit.

Each hit is scored by its window: inside quotation marks or in a cited line it is quoted, otherwise
direct.  A word that hits counts once, by how much more often its entry stands among the words of toxic documents, and
every word counts a little against, as toxic documents have a hit every so many words.  A logistic
curve over these sums, by kind of hit, gives the score; its prior holds what the labels do not tell.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifespan.llm.common import cut, free_names, per_process, pieces_of
from lifespan.llm.words import hashes, run_starts, runs, split

WORD = re.compile(r"\w+(?:[@$!*]\w+)*")
QUOTES = [("“", "”"), ("«", "»"), ("„", "“"), ("‹", "›"), ("‘", "’"), ("»", "«")]
#: Kinds of hits, behind the bias and the length: direct, quoted, near spelling, near spelling quoted.
#: Coefficients before any label is seen, and how firmly they hold.
PRIOR = np.array([-2.0, 1.0, 1.0, 0.15, 0.75, 0.1])
PRIOR_WEIGHT = np.array([0.1, 1.0, 1.0, 5.0, 5.0, 5.0])


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows to learn from, at most (about); ``least`` documents, and ``share``
    of those labelled 1, have an entry; ``lift``: how many times the odds of label 1 are, at least
    (two standard errors off); ``stems``: lengths of stems; ``one_edit`` and ``two_edits``: word
    lengths that allow them; ``window``: characters around a hit."""

    sample: int = 40_000
    least: int = 4
    share: float = 0.005
    lift: float = 5.0
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    one_edit: int = 5
    two_edits: int = 9
    window: int = 120
    known: int = 500_000


PRODUCTION = Settings()


@dataclass
class Model:
    """Words and stems with their strength, spellings that are no hits, hits a word of a toxic
    document is, and the coefficients."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    rate: float = 0.0
    coefficients: tuple[float, ...] = tuple(PRIOR)
    settings: Settings = PRODUCTION


# -- the automaton --------------------------------------------------------------


class Lexicon:
    """Trie of the entries, run together with the Levenshtein automata of a word."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], settings: Settings = PRODUCTION):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.edits: list[int] = [0]
        self.below: list[int] = [0]
        for entry, ends in [*((w, self.word) for w in words), *((s, self.stem) for s in stems)]:
            edits = (len(entry) >= settings.one_edit) + (len(entry) >= settings.two_edits) if ends is self.word else 0
            node = 0
            self.below[0] = max(self.below[0], edits)
            for c in entry:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    for x, new in ((self.word, None), (self.stem, None), (self.edits, 0), (self.below, 0)):
                        x.append(new)
                node = self.child[node][c]
                self.below[node] = max(self.below[node], edits)
            ends[node] = entry
            self.edits[node] = max(self.edits[node], edits)
        self.letters = {c for children in self.child for c in children}
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self._state({(0, None): 0})

    def _state(self, reached: dict[tuple[int, str | None], int]) -> int:
        """The number of a state; letters of the trie may be left out at one edit each."""
        todo = [x for x in reached.items() if x[0][1] is None]
        while todo:
            (node, _), edits = todo.pop()
            for child in self.child[node].values():
                if edits < self.below[child] and reached.get((child, None), 9) > edits + 1:
                    reached[child, None] = edits + 1
                    todo.append(((child, None), edits + 1))
        key = frozenset((node, edits, owed) for (node, owed), edits in reached.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.word[n]) for n, e, owed in key if owed is None and self.word[n] and e <= self.edits[n]]
            self.accepts.append(min(ends, default=None))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[tuple[int, str | None], int] = {}

        def reach(node: int, edits: int, owed: str | None = None) -> None:
            if edits <= self.below[node] and reached.get((node, owed), 9) > edits:
                reached[node, owed] = edits

        for node, edits, owed in self.sets[state]:
            if owed is not None:
                if c == owed:
                    reach(node, edits)
                continue
            reach(node, edits + 1)  # a letter too many
            for letter, child in self.child[node].items():
                reach(child, edits + (letter != c))
                if letter != c and c in self.child[child]:  # two letters swapped
                    reach(self.child[child][c], edits + 1, letter)
        out = self._state(reached) if reached else -1
        self.next[state][c] = out
        return out

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """The entry, its edits and whether it is a stem: the shortest stem in full, else the nearest word."""
        state, node = self.start, 0
        for i, c in enumerate(word, 1):
            if node >= 0:
                node = self.child[node].get(c, -1)
                if node >= 0 and self.stem[node] is not None and i < len(word):
                    return self.stem[node], 0, True
            if state >= 0:
                c = c if c in self.letters else ""
                following = self.next[state].get(c)
                state = self._step(state, c) if following is None else following
            if state < 0 and node < 0:
                return None
        found = self.accepts[state] if state >= 0 else None
        return (found[1], found[0], False) if found else None


class Hits:
    """Finds the hits of a model in texts; what is known of a word is kept while a bounded table lasts."""

    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.words, model.stems, model.settings)
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, int, bool]] = {}

    def of_words(self, words: set[str]) -> dict[str, tuple[str, int, bool]]:
        if len(self.known) > self.model.settings.known:
            self.known, self.hits = set(), {}
        for w in words - self.known:
            found = self.lexicon.match(w)
            if found and not (found[1] and w in self.model.clean):
                self.hits[w] = found
        self.known |= words
        return {w: self.hits[w] for w in words if w in self.hits}

    def strength(self, hit: tuple[str, int, bool]) -> float:
        return (self.model.stems if hit[2] else self.model.words)[hit[0]]

    def features(self, text: str) -> np.ndarray:
        """1, length against, and the strengths of the hits of each kind, as in ``PRIOR``."""
        out = np.zeros(len(PRIOR))
        low = text.lower()
        if len(low) != len(text):  # letters keep their place
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = WORD.findall(low)
        out[:2] = 1, -self.model.rate * len(words)
        found = self.of_words(set(words))
        direct: dict[str, bool] = {}  # a word counts once, as direct if it is so anywhere
        for m in WORD.finditer(low) if found else ():
            if m[0] in found and not direct.get(m[0]):
                direct[m[0]] = not is_quoted(text, m.start(), m.end(), self.model.settings.window)
        for w, plain in direct.items():
            out[2 + 2 * (found[w][1] > 0) + (not plain)] += self.strength(found[w])
        return out


def is_quoted(text: str, start: int, end: int, window: int) -> bool:
    """Whether a hit stands in a cited line (``>``) or between quotation marks within the window."""
    line = text.rfind("\n", 0, start) + 1
    if text[line : line + 8].lstrip().startswith(">"):
        return True
    stop = text.find("\n", end)
    before, after = text[max(line, start - window) : start], text[end : min(end + window, stop if stop >= 0 else len(text))]
    if '"' in after and before.count('"') % 2:
        return True
    return any(before.rfind(x) > before.rfind(y) and y in after for x, y in QUOTES)


# -- learning -------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never read; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """``text, toxic`` of a bounded sample of labelled documents that are not held out, written once.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, toxic``.  Ids are drawn by hash; a document
    labelled twice counts as toxic if either label says so.  Of documents with one label whose
    least hash over runs of five words is the same (copies and most near copies) one stays.
    """
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, settings.sample / max(1, chosen.count()))
    drawn = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            w = split(batch.column("text"), fold=True)
            value, least = hashes(w), np.full(w.n_rows, np.iinfo(np.uint64).max, dtype=np.uint64)
            np.minimum.at(least, w.row, value)
            start = run_starts(w, 5)
            if len(start):
                rows = np.unique(w.row[start])
                least[rows] = np.iinfo(np.uint64).max
                np.minimum.at(least, w.row[start], runs(value, 5)[start])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], ["text", "toxic", "least"])

    sampled = cut(texts.mapInArrow(run, "text string, toxic int, least long").withColumn("row", F.monotonically_increasing_id()))
    # as many rows as the sample has, at most
    first = sampled.groupBy("least", "toxic").agg(F.min("row").alias("first")).select("first")
    return sampled.join(F.broadcast(first), F.col("row") == F.col("first"), "left_semi").select("text", "toxic")


def _term_counts(rows: DataFrame, settings: Settings, wanted: frozenset[str] | None = None) -> DataFrame:
    """``term, n, times, low, high``: documents that have a term, how often they do, its least and
    greatest word.  Terms are words and, behind a space, stems; the empty term is any word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def rows_held() -> pa.RecordBatch:
            columns = zip(*([k, *v] for k, v in held.items())) if held else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["term", "n", "times", "low", "high"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = Counter(WORD.findall((text or "").lower()))
                own: dict[str, list] = {"": [1, sum(words.values()), "", ""]}
                for w, times in words.items():
                    for term in (w, *(" " + w[:k] for k in settings.stems if len(w) > k)):
                        if len(w) > 2 and (wanted is None or term in wanted):
                            x = own.setdefault(term, [1, 0, w, w])
                            x[1:] = x[1] + times, min(x[2], w), max(x[3], w)
                for term, (n, times, low, high) in own.items():
                    x = held.setdefault(term, [0, 0, low, high])
                    x[:] = x[0] + n, x[1] + times, min(x[2], low), max(x[3], high)
                if len(held) > 500_000:
                    yield rows_held()
                    held.clear()
        yield rows_held()

    found = rows.select("text").mapInArrow(run, "term string, n long, times long, low string, high string")
    sums = (F.sum("n").alias("n"), F.sum("times").alias("times"))
    return found.groupBy("term").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))


def lexicon(rows: DataFrame, settings: Settings = PRODUCTION) -> Model:
    """Entries found far more often in rows labelled 1.

    A term of ``share`` of the rows labelled 1 or more comes into question, so there are at most
    ``1 / share`` times the distinct terms of a mean document of them, whatever the number of rows.
    """
    toxic, clean = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    bar = max(settings.least, settings.share * n_toxic)
    found = {r["term"]: r for r in _term_counts(toxic, settings).filter(F.col("n") >= bar).collect()}
    if "" not in found:
        return Model(settings=settings)
    others = {r["term"]: r for r in _term_counts(clean, settings, frozenset(found)).collect()}

    def in_clean(term: str) -> tuple[int, int]:
        return (others[term]["n"], others[term]["times"]) if term in others else (0, 0)

    def odds(term: str) -> float:
        """Lower bound of the log of the odds ratio of label 1 with and without the term."""
        cells = np.array([found[term]["n"], n_toxic - found[term]["n"], in_clean(term)[0], n_clean - in_clean(term)[0]]) + 0.5
        return float(np.log(cells) @ [1, -1, -1, 1] - 2 * np.sqrt((1 / cells).sum()))

    per_word = [max(1, x) for x in (found[""]["times"], in_clean("")[1])]

    def strength(term: str) -> float:
        return float(np.log((found[term]["times"] + 0.5) / per_word[0]) - np.log((in_clean(term)[1] + 0.5) / per_word[1]))

    def gain(term: str) -> float:
        """How much better two rates tell the term's places in toxic and clean rows than one."""
        places = np.array([found[term]["times"], in_clean(term)[1]], dtype=float)
        even = places.sum() * np.array(per_word) / sum(per_word)
        return float((places * np.log(np.maximum(places, 1e-9) / even)).sum())

    # a stem stands in two words or more; of entries that begin with each other the one that tells most, then the shortest
    sure = [t for t in found if t and (t[0] != " " or found[t]["low"] != found[t]["high"]) and odds(t) >= np.log(settings.lift)]
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of entries
    for t in sorted(sure, key=lambda t: (-gain(t), len(t), t)):
        entry, stem = t.strip(), t[0] == " "
        if any(entry[:k] in stems for k in range(1, len(entry) + 1)) or stem and entry in begun:
            continue
        (stems if stem else words)[entry] = strength(t)
        begun.update(entry[:k] for k in range(1, len(entry) + 1))
    entries = [*words, *(" " + s for s in stems)]
    rate = sum(found[t]["times"] for t in entries) / per_word[0] - sum(in_clean(t)[1] for t in entries) / per_word[1]
    return Model(words, stems, rate=max(0.0, rate), settings=settings)


def _clean_spellings(rows: DataFrame, model: Model) -> frozenset[str]:
    """Spellings near an entry, but not it, that stand in rows labelled 0 more often than not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, count = Hits(model), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                near = hits.of_words(set(WORD.findall((text or "").lower())))
                count.update((w, toxic) for w, h in near.items() if h[1])
        keys = list(count)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([count[k] for k in keys], pa.int64())], ["word", "toxic", "n"])

    found = rows.mapInArrow(run, "word string, toxic int, n long").groupBy("word")
    found = found.agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(-F.col("n"))).alias("more"))
    # at most as many as there are spellings near a bounded number of entries
    return frozenset(r["word"] for r in found.filter("more >= 0").collect())


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = PRODUCTION) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out.

    Without labels, or with none of 1, the lexicon is empty and every score is that of the bias.
    """
    rows = training_rows(docs, labels, settings)
    model = lexicon(rows, settings)
    model.clean = _clean_spellings(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(model)
        for batch in pieces_of(batches, "text"):
            found = [hits.features(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    # a few numbers for each row of the bounded sample; equal rows are one
    grouped = rows.mapInArrow(run, "x array<double>, toxic int").groupBy("x", "toxic").count().orderBy("toxic", "x").collect()
    x = np.array([r["x"] for r in grouped], dtype=float).reshape(-1, len(PRIOR))
    coefficients = logistic(x, np.array([float(r["toxic"] > 0) for r in grouped]), np.array([float(r["count"]) for r in grouped]))
    return Model(model.words, model.stems, model.clean, model.rate, tuple(coefficients.tolist()), settings)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients of most probability under the prior, by Newton steps that are halved if they fail."""

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (PRIOR_WEIGHT * (c - PRIOR) ** 2).sum() / 2)

    c = PRIOR.copy()
    for _ in range(50):
        p = _sigmoid(x @ c)
        slope = x.T @ (n * (p - y)) + PRIOR_WEIGHT * (c - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(PRIOR_WEIGHT), slope)
        while loss(c - step) > loss(c) and np.abs(step).max() > 1e-9:
            step = step / 2
        c = c - step
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([c[:1], np.maximum(c[1:], 0)])  # a hit never speaks against toxicity


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1) and the strengths of the hits of each kind
    (``direct, quoted, near, near_quoted``) behind its columns; names that clash get an underscore.

    Null or empty text scores as text without a hit.  No shuffle; one row out per row in.
    """
    names = free_names(docs.drop(text), "score", "direct", "quoted", "near", "near_quoted")
    kept = [f for f in docs.schema.fields if f.name != text]
    held = (tuple(sorted(model.words.items())), tuple(sorted(model.stems.items())), tuple(sorted(model.clean)), model.rate, model.settings)
    key = f"toxicity {hash(held)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = per_process(key, lambda: Hits(model))
        for batch in pieces_of(batches, text):
            x = np.stack([hits.features(t or "") for t in batch.column(text).to_pylist()])
            columns = [pa.array(_sigmoid(x @ np.array(model.coefficients))), *(pa.array(x[:, k]) for k in range(2, len(PRIOR)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), *names])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in names)]))
