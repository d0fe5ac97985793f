"""The corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, BPE encoding and decoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last keep the columns of
``documents``. Mixing may repeat a document, as its weight asks for.

The tables a stage makes on its way live until the next stage over the same data starts, so its
result has to be written before, as ``run`` does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import bpe, exact_dedup, mixing, near_dedup, quality
from rillflow.llm.queries import BYTE_BPE, coded_digests
from rillflow.scratch import recording, remove, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: dict[tuple[str, str], list[str]] = {}


def _freeing(stage: Stage) -> Stage:
    """Removes what the stage before left behind."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        for path in _LEFT.pop(key, ()):
            remove(spark, path)
        with recording() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT[key] = made
        return out

    return run_stage


@_freeing
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from every language reference go."""
    return quality.filter_documents(docs)


@_freeing
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.grace_dedup(docs)[1]


@_freeing
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents the one with the smallest id stays."""
    return near_dedup.keep_one(docs)


@_freeing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix_documents(docs)


@_freeing
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document of the mix."""
    return coded_digests(bpe.encode_and_decode(docs, BYTE_BPE()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: Shingle similarity, sampling in two levels and BPE merges are not for SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
