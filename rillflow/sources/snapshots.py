"""Read-only snapshots of a table of series.

Every write makes a folder of its own below ``data`` and then one row in the table ``log``: number,
branch, the folders that belong to the snapshot, rows, first and last time. What has no row does not
exist for readers, so a torn write stays invisible and a snapshot never changes once it is written.
A branch points to its snapshot of the highest number.

One writer per branch at a time; readers need no lock. Rows without a time count as rows but not in
the range of times. An empty table makes a snapshot without rows whose range is NULL.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rillflow.sources.readers import path_exists, read_table

LOG = "number long, branch string, folders array<string>, n_rows long, first timestamp, last timestamp"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per snapshot of the table at ``path``; none if nothing was written yet."""
    if not path_exists(spark, f"{path}/log"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{path}/log")


def find_snapshot(spark: SparkSession, path: str, branch: str = "main", number: int | None = None) -> Row:
    """The log row of one snapshot, by default the latest of the branch."""
    known = snapshots(spark, path).filter(F.col("branch") == branch)
    if number is not None:
        known = known.filter(F.col("number") == number)
    found = known.orderBy(F.desc("number")).head()
    if found is None:
        raise KeyError(f"{path}: no snapshot {number if number is not None else ''} on {branch}")
    return found


def write_snapshot(df: DataFrame, path: str, branch: str = "main", time: str = "ts", append: bool = False) -> int:
    """Writes ``df`` as the next snapshot of the branch and returns its number.

    ``append`` keeps the rows of the branch's latest snapshot, whose folders are listed again, not copied.
    """
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{folder}")
    written = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    seen = written.agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).head()
    n, first, last, folders = seen.n, seen.first, seen.last, [folder]
    latest = snapshots(spark, path).agg(F.max("number").alias("number")).head().number
    if append and snapshots(spark, path).filter(F.col("branch") == branch).head() is not None:
        old = find_snapshot(spark, path, branch)
        n, folders = n + old.n_rows, [*old.folders, folder]
        first = min((t for t in (first, old.first) if t is not None), default=None)
        last = max((t for t in (last, old.last) if t is not None), default=None)
    number = 0 if latest is None else latest + 1
    row = spark.createDataFrame([(number, branch, folders, n, first, last)], LOG)
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return number


def read_snapshot(spark: SparkSession, path: str, branch: str = "main", number: int | None = None) -> DataFrame:
    """Rows of one snapshot, by default the latest of the branch."""
    found = find_snapshot(spark, path, branch, number)
    return read_table(spark, [f"{path}/{folder}" for folder in found.folders])


def read_covered(spark: SparkSession, path: str, start: datetime, end: datetime, step: timedelta, time: str = "ts", branch: str = "main") -> DataFrame:
    """Rows of the branch in [start, end); raises if the snapshot does not reach that far.

    The log decides, so no data are read for the test.
    """
    found = find_snapshot(spark, path, branch)
    if found.first is None or start < found.first or end > found.last + step:
        raise ValueError(f"[{start}, {end}) is not covered: {path} holds {found.first} to {found.last}")
    rows = read_snapshot(spark, path, branch, found.number)
    return rows.filter((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
