"""Intermediate tables that cut lineage.

Iterative operators write each round as a parquet table below the shared folder
named by ``spark.checkpoint.dir`` and read it back. A lost executor then costs a
re-read, not a recomputation of all earlier rounds, and the file sizes give the
optimizer exact statistics for its choice of join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder of the session; only a local session may get one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="rillflow-"))
    return context.getCheckpointDir().rstrip("/")


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


@contextmanager
def recording() -> Iterator[list[str]]:
    """Collects the scratch paths handed out inside the block, for a later ``remove``."""
    paths: list[str] = []
    token = _recorded.set(paths)
    try:
        yield paths
    finally:
        _recorded.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    if (paths := _recorded.get()) is not None:
        paths.append(path)
    return path


def store(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides by key.

    Tables with a row per reach meet in many rounds; as long as they are small, each would else be
    collected and broadcast by the driver, round after round.
    """
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step can need."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; DataFrames that read them become unusable."""
    remove(spark, f"{scratch_root(spark)}/tables/{spark.sparkContext.applicationId}")
