"""Exact deduplication by Grace hashing with complete content comparison.

1. *Pre-combine.* Every input partition runs an open-addressing table over its texts and
   keeps one record per different text (its content, its best row, its number of rows); rows
   themselves leave without their text, pointing to that record. A text that makes up a
   third of the corpus therefore moves once per input partition, not once per row. The table
   is flushed when its contents reach ``TABLE_BYTES``.
2. *Partition.* Records are cut into buckets by the leading hex digits of a 64-bit hash.
   Buckets whose different contents exceed ``BUCKET_BYTES`` are cut again by the next digit,
   until all fit. Only (hash, length) pairs are read for this; texts move once, into their
   final bucket, and the shuffle files are the spill files.
3. *Table.* Each bucket is streamed into an open-addressing table that compares complete
   contents, so a hash collision never joins two texts.
4. Rows join the decision of their record.

NULL text counts as empty. Of equal texts the row with the largest ``doc_id`` stays (NULL
ids last); among rows that repeat both text and id exactly one stays. Columns other than
``doc_id`` and ``text`` travel in one struct, so their names cannot clash. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rillflow.llm.caching import giving_back
from rillflow.scratch import store

TABLE_BYTES = 48 << 20
BUCKET_BYTES = 16 << 20


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.size = 0

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """Number of the entry and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.size += len(content)
        if 10 * len(self.contents) > 7 * len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _rank(doc_id: int | None) -> tuple[bool, int]:
    return (doc_id is not None, doc_id or 0)


def _precombine(schema: pa.Schema, limit: int):
    """Rows without text, and one record per different text; ``kind`` tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        made = seen = 0
        entries, best, counts = ContentTable(), [], []

        def emit(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
            )

        def flush() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(best), 512):
                hi = min(lo + 512, len(best))
                yield emit(
                    {
                        "kind": pa.array(["text"] * (hi - lo)),
                        "gid": pa.array([base + made + i for i in range(lo, hi)]),
                        "h": pa.array(entries.hashes[lo:hi]),
                        "content": pa.array(entries.contents[lo:hi], pa.large_binary()),
                        "n_bytes": pa.array([len(c) for c in entries.contents[lo:hi]]),
                        "doc_id": pa.array([b[0][1] if b[0][0] else None for b in best[lo:hi]], pa.int64()),
                        "row": pa.array([b[1] for b in best[lo:hi]]),
                        "n_rows": pa.array(counts[lo:hi]),
                    },
                    hi - lo,
                )

        for batch in batches:
            gids = []
            hashes, ids = batch.column("h").to_pylist(), batch.column("doc_id").to_pylist()
            for i, content in enumerate(batch.column("content")):
                entry, new = entries.find_or_add(hashes[i], content.as_py())
                mine = (_rank(ids[i]), base + seen + i)
                if new:
                    best.append(mine)
                    counts.append(1)
                else:
                    counts[entry] += 1
                    if mine[0] > best[entry][0]:
                        best[entry] = mine
                gids.append(base + made + entry)
                if entries.size > limit:
                    yield from flush()
                    made += len(best)
                    entries, best, counts = ContentTable(), [], []
            n = batch.num_rows
            yield emit(
                {
                    "kind": pa.array(["row"] * n),
                    "gid": pa.array(gids, pa.int64()),
                    "doc_id": batch.column("doc_id"),
                    "row": pa.array(np.arange(n, dtype=np.int64) + base + seen),
                    "payload": batch.column("payload"),
                },
                n,
            )
            seen += n
        yield from flush()

    return giving_back(run)


_DECIDED = pa.schema(
    [("gid", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("keep_gid", pa.int64()), ("group_size", pa.int64()), ("sha256", pa.string())]
)


@giving_back
def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches arrive sorted by bucket; one table lives at a time."""
    bucket, entries = None, ContentTable()
    best: list[tuple] = []
    counts: list[int] = []
    members: list[tuple[int, int]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        digests = [hashlib.sha256(c).hexdigest() for c in entries.contents]
        for lo in range(0, len(members), 8192):
            part = members[lo : lo + 8192]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in part], pa.int64()),
                    pa.array([best[e][0][1] if best[e][0][0] else None for _, e in part], pa.int64()),
                    pa.array([best[e][1] for _, e in part], pa.int64()),
                    pa.array([best[e][2] for _, e in part], pa.int64()),
                    pa.array([counts[e] for _, e in part], pa.int64()),
                    pa.array([digests[e] for _, e in part]),
                ],
                schema=_DECIDED,
            )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "gid", "h", "doc_id", "row", "n_rows")]
        for i, (b, gid, h, doc_id, row, n_rows) in enumerate(zip(*columns, strict=True)):
            if b != bucket:
                yield from flush()
                bucket, entries, best, counts, members = b, ContentTable(), [], [], []
            entry, new = entries.find_or_add(h, batch.column("content")[i].as_py())
            mine = (_rank(doc_id), row, gid)
            if new:
                best.append(mine)
                counts.append(n_rows)
            else:
                counts[entry] += n_rows
                best[entry] = max(best[entry], mine)
            members.append((gid, entry))
    yield from flush()


def with_buckets(records: DataFrame, limit: int) -> DataFrame:
    """Adds ``bucket``: the shortest prefix of the hash's hex digits whose different contents fit ``limit``."""
    hashes = records.groupBy("h").agg(F.max("n_bytes").alias("n_bytes")).withColumn("digits", F.lpad(F.hex("h"), 16, "0"))
    total = hashes.agg(F.sum("n_bytes")).first()[0] or 0
    depth = 0
    while 16**depth * limit < total and depth < 15:
        depth += 1
    out = records.withColumn("bucket", F.substring(F.lpad(F.hex("h"), 16, "0"), 1, depth))
    while depth < 16:
        # the prefixes that are still too large; uniform hashing leaves none or few
        large = hashes.groupBy(F.substring("digits", 1, depth).alias("bucket")).agg(F.sum("n_bytes").alias("held"), F.count("*").alias("n"))
        large = large.filter((F.col("held") > limit) & (F.col("n") > 1)).select("bucket", F.lit(True).alias("large"))
        if large.isEmpty():
            break
        depth += 1
        deeper = F.substring(F.lpad(F.hex("h"), 16, "0"), 1, depth)
        out = out.join(large, "bucket", "left").withColumn("bucket", F.when(F.col("large"), deeper).otherwise(F.col("bucket"))).drop("large")
        hashes = hashes.join(large.withColumnRenamed("bucket", "was"), F.substring("digits", 1, depth - 1) == F.col("was"), "left_semi")
    return out


def grace_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(decisions, kept documents).

    Decisions: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.
    Kept documents: the rows that stay, with the columns of the input.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    payload = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    content = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        content.cast("binary").alias("content"),
        F.xxhash64(content).alias("h"),
        F.col("text").isNull().alias("was_null"),
        payload.alias("payload"),
    ).select("doc_id", "content", "h", F.struct("was_null", F.col("payload").alias("rest")).alias("payload"))
    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("gid", T.LongType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("row", T.LongType()),
            T.StructField("h", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_rows", T.LongType()),
            T.StructField("content", T.BinaryType()),
            T.StructField("payload", slim.schema["payload"].dataType),
        ]
    )
    combined = store(slim.mapInArrow(_precombine(to_arrow_schema(schema), table_bytes), schema), "precombined", ["kind"])
    rows = combined.filter("kind = 'row'").select("gid", "doc_id", "row", "payload")
    records = combined.filter("kind = 'text'").select("gid", "h", "n_bytes", "n_rows", "doc_id", "row", "content")
    dealt = with_buckets(records, bucket_bytes).repartition("bucket").sortWithinPartitions("bucket")
    decided = store(
        dealt.select("bucket", "gid", "h", "doc_id", "row", "n_rows", "content").mapInArrow(
            _decide, "gid long, keep_id long, keep_row long, keep_gid long, group_size long, sha256 string"
        ),
        "decided",
    )
    decisions = rows.join(decided, "gid").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
    # the winner's text is that of its own record, so only texts that stay are read again
    winners = decided.filter("gid = keep_gid").select("gid", F.col("keep_row").alias("row"))
    kept = rows.join(winners, ["gid", "row"]).join(records.select("gid", "content"), "gid")
    text = F.when(~F.col("payload.was_null"), F.col("content").cast("string")).alias("text")
    back = {c: F.col("payload.rest").getField(c).alias(c) for c in others} | {"text": text, "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")}
    return decisions, kept.select(*[back[c] for c in docs.columns])
