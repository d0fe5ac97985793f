"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass 1 scatters rows uniformly into buckets by a seeded hash; a bucket is sized to fit a
task's memory. Pass 2 puts every bucket, alone in its partition, into a fixed order and
applies Spark's Fisher-Yates ``shuffle`` to it. The buckets one after the other are the
shuffled corpus; shards are equal stretches of it, so their counts differ by one at most and
a bucket is written to few of them: ``write_shards`` makes about as many files as buckets.

The hash covers id and text, so rows without an id still spread; copies of one text under
different ids land in different buckets. ``CELLS`` fine cells are counted once; buckets are
runs of cells, which gives both their number and every bucket's first position from one
aggregate of at most ``CELLS`` rows.

NULL text counts as empty: no bytes, checksum 0. A very long text moves whole, once. Rows equal
in id and text are interchangeable. Other columns travel untouched whatever their names and types (maps included);
``write_shards`` keeps them in the struct ``record``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from rillflow.llm.common import parts_for
from rillflow.scratch import scratch_path, store

#: Also bounds the table of first positions that is broadcast: two million rows of an int and a long.
CELLS = 1 << 21
BUCKET_BYTES = 24 << 20
ROW_BYTES = 16


def cell_of(seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(CELLS))


def external_shuffle(rows: DataFrame, key: list[str], n_bytes: str, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``position`` (gapless from 0) and ``record``, a struct of the columns of ``rows``, in shuffled order; and the number of rows.

    ``key`` names the columns that decide the bucket and the order before the shuffle.
    """
    cell = cell_of(seed, *[F.col(f"`{c}`") for c in key])
    counted = store(rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(n_bytes).alias("held")), "cells")
    total = counted.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    buckets = min(CELLS, parts_for(total["held"], bucket_bytes))
    bucket = F.floor(F.col("cell") * buckets / CELLS).cast("int")
    order = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first")
    )
    record = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    sort_key = F.struct(*[F.col(f"`{c}`") for c in key])
    scattered = rows.select(F.floor(cell * buckets / CELLS).cast("int").alias("bucket"), sort_key.alias("sort_key"), record.alias("record"))
    dealt = scattered.repartitionById(buckets, "bucket")
    # one bucket a partition: the seed of a partition is the seed of its bucket
    whole = dealt.groupBy("bucket").agg(F.collect_list(F.struct("sort_key", "record")).alias("held"))
    # the records stay out of the comparison: their columns may be of a type without an order
    order_of = F.transform("held", lambda x, i: F.struct(x["sort_key"].alias("sort_key"), i.alias("i")))
    dealt_at = F.shuffle(F.sort_array(order_of), F.lit(seed))
    mixed = whole.select("bucket", F.posexplode(F.transform(dealt_at, lambda o: F.get("held", o["i"]))).alias("at", "row"))
    placed = mixed.join(F.broadcast(first), "bucket").select((F.col("first") + F.col("at")).alias("position"), "row.record")
    return placed, total["n"]


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``record, size, text_crc32, shard, slot``; ``record`` holds the columns of ``docs``."""
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("k_id"),
        F.crc32(text.cast("binary")).alias("k_crc32"),
        F.xxhash64(text).alias("k_hash"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("k_size"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
    )
    mixed, n = external_shuffle(rows, ["k_id", "k_hash"], "k_size", seed, bucket_bytes)
    # shard s holds the positions from floor(s n / shards) to the next one's first
    mixed = mixed.withColumn("shard", F.expr(f"({shards} * (position + 1) - 1) div {max(n, 1)}"))
    return mixed.select(
        F.col("record.row").alias("record"),
        F.col("record.k_size").alias("size"),
        F.col("record.k_crc32").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * {n}) div {shards}")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 40, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> str:
    """Writes ``slot, size, text_crc32, record`` as Parquet, one folder per shard, and returns the path."""
    path = path or scratch_path(docs.sparkSession, "shards")
    shard(docs, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """What ``write_shards`` wrote of ``docs``, with ``shard`` as a column."""
    schema = StructType().add("record", docs.schema)
    for name, kind in (("size", LongType()), ("text_crc32", LongType()), ("slot", LongType()), ("shard", IntegerType())):
        schema = schema.add(name, kind)
    return spark.read.schema(schema).parquet(path)
