"""Corpus preparation: toxicity, near-duplicates, secrets, mixing and encoding, each stage on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsexp.llm import mixing, near_dedup, pieces, secrets, toxicity
from obsexp.llm.common import prepare
from obsexp.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. The labels come from the table beside the documents."""
    return toxicity.clean_documents(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id."""
    prepare(spark)
    return near_dedup.distinct_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mark; no document goes."""
    prepare(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, so that the words of each source come near its target."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    prepare(spark)
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("piece encoding", encode_pieces),
]
# Hash sampling, fitted scores and similarity search are beyond SQL; tests/llm/test_pipeline.py holds the stages against
# plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
