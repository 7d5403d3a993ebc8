"""Mixing sources to target weights.

Tokens are added up per source, targets follow from weights and caps, and a document is emitted
``floor(rate)`` times plus once more if its hash, seeded per source, falls below the fraction.
Of a few seeds the one whose copies come nearest to the target is taken: every document still has
the same chance, and a source with few documents does not miss its target by bad luck.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifespan.llm.common import WORD, cut, free_names, positions, whole_text

#: Up to so many sources the table of rates is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Weights:
    """Weights by place of the source in code point order (null last), and shares of all tokens."""

    cycle: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    seeds: int = 32


PRODUCTION = Weights()


def word_count(name: str = "text") -> Column:
    return F.regexp_count(whole_text(name), F.lit(WORD)).cast("long")


def rates(docs: DataFrame, weights: Weights = PRODUCTION, size: Column | None = None) -> DataFrame:
    """One row per source: ``source, source_size, target, rate, seed``.

    ``target`` is the source's share of ``weights.share`` times all tokens, never above
    ``weights.cap`` times its own; what is cut off goes to the others by weight until none is
    above.  A source without tokens has target and rate 0.  An empty table gives no rows.
    """
    size = word_count() if size is None else size
    # text is read once; what follows works on three numbers per document
    sized = cut(docs.select("doc_id", "source", size.alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = positions(totals, [F.col("source").asc_nulls_last()], "place")
    by_place = F.element_at(F.array(*map(F.lit, weights.cycle)), (F.col("place") % len(weights.cycle) + 1).cast("int"))
    weighed = cut(placed.select("source", "source_size", by_place.cast("double").alias("weight")))
    target = _levelled(weighed, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = weighed.select("source", "source_size", target.alias("target")).withColumn("rate", rate)
    n_sources = weighed.count()
    drawn = _with_rates(sized, rated, n_sources)
    sums = [
        F.sum(F.col("size") * copies(F.col("doc_id"), F.col("rate"), F.lit(k))).alias(f"taken_{k}") for k in range(weights.seeds)
    ]
    missed = F.array(*(F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(weights.seeds)))
    tried = drawn.groupBy("source", "source_size", "target", "rate").agg(*sums)
    return cut(tried.select("source", "source_size", "target", "rate", F.array_min(missed)["seed"].alias("seed")))


def _levelled(weighed: DataFrame, weights: Weights) -> Column:
    """Target of a row of ``weighed``: weight times a level, or its cap.

    The level rises in rounds; each looks at one row of sums, and ends when no further source is
    at its cap.
    """
    ceiling = F.col("source_size") * weights.cap
    all_sizes, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = weights.share * float(all_sizes or 0)
    level, known = wanted / all_weights if all_weights else 0.0, -1
    while True:
        above = ceiling <= F.col("weight") * level
        capped, free, n = weighed.agg(
            F.sum(F.when(above, ceiling).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)
        ).first()
        if not free or n == known:
            return F.when(above, ceiling).otherwise(F.col("weight") * level)
        level, known = max(level, (wanted - capped) / free), n


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    """How often a document is emitted: the whole part of the rate, and one more by hash."""
    # 53 bits of the hash make a fraction from 0 up to, but without, 1
    draw = F.shiftrightunsigned(F.xxhash64(doc_id, seed), 11).cast("double") * F.lit(2.0**-53)
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


def _with_rates(docs: DataFrame, rated: DataFrame, n_sources: int) -> DataFrame:
    side = F.broadcast(rated) if n_sources <= BROADCAST_SOURCES else rated
    return docs.join(side.withColumnRenamed("source", "source__"), F.col("source").eqNullSafe(F.col("source__")), "left").drop("source__")


def with_copies(docs: DataFrame, rated: DataFrame, name: str = "copies") -> DataFrame:
    """``docs`` (with ``doc_id`` and ``source``) with the rates of their source and their copies.

    Rows with the same id and source get the same number; a null id is an id like others.
    """
    joined = _with_rates(docs, rated, rated.count())
    return joined.withColumn(name, copies(F.col("doc_id"), F.col("rate"), F.col("seed")))


def emit(docs: DataFrame, weights: Weights = PRODUCTION) -> DataFrame:
    """The mixture: rows of ``docs`` repeated, with its columns unchanged.

    A null source is one of its own, the last; null and empty texts have size 0 and the rate of their
    source.  Equal rows draw alike; columns of any name stay, and an empty table stays empty.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    drawn = with_copies(packed, rates(docs, weights))
    each = drawn.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return each.select(*(F.col("row").getField(c).alias(c) for c in columns))
