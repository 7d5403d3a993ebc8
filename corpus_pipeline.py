"""A training corpus from ``documents``: five stages, each on all rows its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet
to the shared folder and reads it back as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lifespan.llm import mixing, quality, queries, secret_scan, superminhash
from lifespan.llm.common import documents, new_folder
from lifespan.sources.storage import remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go; null and empty texts are among them."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more alike) stays, the one with the smallest id;
    of equal rows one stays, texts without a word all stay."""
    return superminhash.keep_one(docs, superminhash.Settings(percent=80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays, null texts as they are."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come to their targets; a null source is one of its own."""
    return mixing.emit(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of every text, and digests of its ids and of what they decode to; null text as empty."""
    return queries.piece_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: SQL has no SentencePiece; ``tests/llm/test_pipeline.py`` holds the stages against SQL and plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's folder goes when the next one is written.

    An empty table gives an empty result with the columns of the last stage.
    """
    docs = documents(spark, sf_dir)
    folder, before = new_folder(spark, "pipeline"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
