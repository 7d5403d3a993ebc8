"""Secrets, judged by how widely their values are owned over the whole corpus.

Texts are scanned once for candidates.  Values are hashed, and a hash is counted by distinct
repositories and distinct owners: one that many owners hold is a copied example, one that few hold
looks live, in however many repositories it stands.  Spans of the base kinds are always reported; spans of the wider kinds only if their
value is not copied.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifespan.llm.common import cut, free_names, pieces_of, whole_text

#: Fixed forms of the base kinds: pattern, group that holds the value, its least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Wider kinds, reported only where the value is not copied; fixed public forms of keys.
WIDER = (
    ("private", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 60),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32),
    ("prefixed", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk_live_|rk_live_)[A-Za-z0-9_-]{16,}", 0, 20),
    ("opaque", r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24),
)
KINDS = tuple(k[0] for k in BASE + WIDER)

FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("kind", T.IntegerType()),
            T.StructField("end", T.LongType()),
            T.StructField("hash", T.BinaryType()),
        ]
    )
)


@dataclass(frozen=True)
class Policy:
    """A value is a copied example if more owners than this hold it; repositories do not decide."""

    owners: int = 3


PRODUCTION = Policy()


class Scanner:
    def __init__(self):
        # the pattern of a hex value needs whole runs only, so short ones need not be tried twice
        self.base = [(re.compile(p.replace("[0-9a-f]+", "[0-9a-f]{32,}"), re.ASCII), g, n) for _, p, g, n in BASE]
        self.wider = [(re.compile(p, re.ASCII), g, n) for _, p, g, n in WIDER]

    def scan(self, text: str) -> list[tuple[int, int, int, bytes]]:
        """Start, kind, end and hashed value of every candidate; wider ones only clear of others."""
        out = []
        for kind, (pattern, group, least) in enumerate(self.base):
            out += [
                (m.start(), kind, m.end(), _hash(m.group(group))) for m in pattern.finditer(text) if len(m.group(group)) >= least
            ]
        taken = _merged([(a, b) for a, _, b, _ in out])
        for kind, (pattern, group, least) in enumerate(self.wider, len(BASE)):
            # both rise: one pass over the matches and the ranges taken before
            own, at = [], 0
            for m in pattern.finditer(text):
                while at < len(taken) and taken[at][1] <= m.start():
                    at += 1
                value = m.group(group)
                if len(value) < least or (at < len(taken) and taken[at][0] < m.end()):
                    continue
                if KINDS[kind] != "opaque" or _random_looking(value):
                    out.append((m.start(), kind, m.end(), _hash(value)))
                    own.append((m.start(), m.end()))
            taken = _merged(taken + own)
        return sorted(out)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _hash(value: str) -> bytes:
    return hashlib.sha256(value.encode()).digest()[:16]


def _random_looking(value: str) -> bool:
    """Letters of both cases and numbers, and 3.5 bits or more per character."""
    if not (re.search("[a-z]", value) and re.search("[A-Z]", value) and len(re.findall("[0-9]", value)) >= 3):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.5


def candidates(docs: DataFrame, text: str = "text", name: str = "found") -> DataFrame:
    """``docs`` without its text, with the candidates of the whole text (null: none)."""
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.binary())]))
        for batch in pieces_of(batches, text):
            found = [
                [dict(zip(("start", "kind", "end", "hash"), c)) for c in scanner.scan(t or "")] for t in batch.column(text).to_pylist()
            ]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*(f.name for f in kept), name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, FOUND)]))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each hash, from rows ``repository, owner, found``.

    A row names a hash once however often it has it; rows are counted per repository and owner
    before hashes meet, so a value in a third of all rows is spread and summed.  A null owner or
    repository counts as one of its own.
    """
    uses = found.select(
        F.coalesce(F.col("repository").cast("string"), F.lit("\0")).alias("repository"),
        F.coalesce(F.col("owner").cast("string"), F.lit("\0")).alias("owner"),
        F.explode(F.array_distinct(F.transform("found", lambda c: c["hash"]))).alias("hash"),
    )
    return uses.groupBy("hash").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))


def spans(docs: DataFrame, policy: Policy = PRODUCTION, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``print`` (hash of the text) and ``spans``.

    A span has ``start, kind (number in KINDS), end`` in code points, ``copied``, and the counts
    behind it; spans are sorted.  Rows without spans have an empty list; null text has none.
    Repeated rows are judged alike and stay repeated.
    """
    chosen = docs.select(
        "doc_id", F.col(repository).alias("repository"), F.col(owner).alias("owner"), "text", F.xxhash64(whole_text()).alias("print")
    )
    # written once: the text is scanned once, and the row numbers stay what they are
    found = cut(candidates(chosen)).withColumn("row", F.monotonically_increasing_id())
    each = found.filter(F.size("found") > 0).select("row", "doc_id", "print", F.explode("found").alias("c"))
    counted = each.join(ownership(found).withColumnRenamed("hash", "owned"), F.col("c.hash") == F.col("owned"))
    copied = F.col("owners") > policy.owners
    judged = counted.withColumn("copied", copied).filter((F.col("c.kind") < len(BASE)) | ~F.col("copied"))
    span = F.struct("c.start", "c.kind", "c.end", "copied", "owners", "repositories")
    grouped = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    with_some = found.filter(F.size("found") > 0).select("row", "doc_id", "print").join(grouped, "row", "left")
    kind = grouped.schema["spans"].dataType
    none = found.filter(F.size("found") == 0).select("doc_id", "print", F.array().cast(kind).alias("spans"))
    return with_some.select("doc_id", "print", F.coalesce("spans", F.array().cast(kind)).alias("spans")).unionByName(none)


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redact(docs: DataFrame, policy: Policy = PRODUCTION, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in its text replaced; other columns and other rows unchanged.

    ``n_chars``, where it is a column, follows the new text.  Overlapping spans become one mark.
    """
    found = spans(docs, policy).filter(F.size("spans") > 0)
    doc_id, seen, cuts = free_names(docs, "doc_id__", "print__", "cuts__")
    known = found.dropDuplicates(["doc_id", "print"]).select(
        F.col("doc_id").alias(doc_id), F.col("print").alias(seen), F.transform("spans", lambda s: F.array(s["start"], s["end"])).alias(cuts)
    )
    matched = docs.join(known, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64(whole_text()) == F.col(seen)), "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            texts = batch.column("text").to_pylist()
            changed = [i for i, c in enumerate(batch.column(cuts).to_pylist()) if c]
            for i in changed:
                texts[i] = _cut_out(texts[i], batch.column(cuts)[i].as_py(), mark)
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                sizes = columns["n_chars"].to_pylist()
                for i in changed:
                    sizes[i] = len(texts[i])
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return matched.select(*(F.col(f"`{n}`") for n in names), cuts).mapInArrow(run, docs.schema)


def _cut_out(text: str, found: list[list[int]], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted(found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
