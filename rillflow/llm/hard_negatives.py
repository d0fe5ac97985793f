"""Hard-negative mining with bounds along a spanning tree of the anchors.

1. *Blocks.* Rows are packed in blocks of ``CANDIDATES`` rows, anchors (sorted by label and by the side of
   a few random planes they lie on, so that neighbours meet) in blocks of ``ANCHORS``. Every pair of blocks is
   one tile: the stated anchors are set against all rows, block by block, and no block grows with the data. Tiles
   come from a product of the stored partitions, without a shuffle or a broadcast of blocks.
2. *Tree.* In a tile the anchors of a block are walked along their minimum spanning tree. The score of a
   candidate at an anchor differs from its score at the parent by at most the length of the edge times the
   norm of the candidate. A candidate not rescored at the parent hands on the interval it has there. Only
   candidates whose interval overlaps what the anchor still asks for are rescored, exactly.
3. *Positives.* First pass: the best rows of the anchor's label. What is asked for starts at the score of the
   last of the parent's best rows, rescored at the child.
4. *Negatives.* Second pass: every positive asks for the best rows of other labels in its window, from
   ``low`` to ``high`` percent of its score; again the parent's choice sets the floor.
5. Tiles return their best few rows for each anchor (and positive); a rank over those gives the result.

Scores are integers; components count as ``floor(256 * x)``. They are computed as doubles where these are
exact (dimension times the largest products below 2**53), else as 64-bit integers without bounds.
Ties go to the smaller id. A score that leaves 64 bits is taken modulo 2**64.

Rows with a NULL label or vector, or with a NULL or non-finite component, take no part. Rows that repeat an
id are rows of their own, as anchors too; the other one may be a positive. A NULL id is never an anchor and
comes last in ties. Vectors of different lengths meet on their common components (the shorter one is filled
with zeros). A window of a negative score is empty. An anchor without positives, a positive without
negatives and an empty table give no rows. Columns other than ``vec_id``, ``embedding``, ``label`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillflow.llm.common import parts_for
from rillflow.scratch import store

CANDIDATES, ANCHORS, PLANES = 4096, 256, 12
LAST = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min
BLOCK = "part long, size int, width int, packed binary"


def _pack(width: int, limit: int, known: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One record for at most ``limit`` rows of a partition: row, id, label, ``known`` integers, components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            ints = [table.column(c).fill_null(LAST).to_numpy() for c in ("row", "vec_id", "label", *known)]
            q = np.zeros((table.num_rows, width))
            for k, v in enumerate(table.column("v").to_pylist()):
                q[k, : len(v)] = v
            packed = np.stack(ints).astype("<i8").tobytes() + np.floor(256.0 * q).astype("<f8").tobytes()
            values = [int(table.column("part")[0].as_py()), table.num_rows, width, packed]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "size", "width", "packed"])

        for batch in batches:
            rest.append(batch)
            while sum(b.num_rows for b in rest) >= limit:
                table = pa.Table.from_batches(rest)
                yield out(table.slice(0, limit))
                rest[:] = table.slice(limit).to_batches()
        if sum(b.num_rows for b in rest):
            yield out(pa.Table.from_batches(rest))

    return run


class Block:
    def __init__(self, size: int, width: int, packed: bytes, known: int = 0) -> None:
        ints = np.frombuffer(packed, "<i8", size * (3 + known)).reshape(3 + known, size)
        self.row, self.id, self.label, self.known = ints[0], ints[1], ints[2], ints[3:]
        self.q = np.frombuffer(packed, "<f8", size * width, offset=8 * ints.size).reshape(size, width)
        self.largest = float(np.abs(self.q).max()) if size and width else 0.0


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(child, parent, distance) in the order of a walk from point 0, whose parent is -1."""
    n = len(points)
    square = (points * points).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2.0 * points @ points.T, 0.0))
    near, parent = apart[0].copy(), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    inside[0] = True
    children: list[list[int]] = [[] for _ in range(n)]
    for _ in range(n - 1):
        k = int(np.where(inside, np.inf, near).argmin())
        inside[k] = True
        children[parent[k]].append(k)
        closer = ~inside & (apart[k] < near)
        near[closer], parent[closer] = apart[k][closer], k
    out, todo = [], [(0, -1)]
    while todo:
        k, p = todo.pop()
        # the distance is taken from the difference, as cancellation may make the product form too small
        out.append((k, p, float(np.sqrt(((points[k] - points[p]) ** 2).sum())) if p >= 0 else 0.0))
        todo += [(c, k) for c in children[k]]
    return out


def best(score: np.ndarray, ids: np.ndarray, wanted: int) -> np.ndarray:
    """Positions of the first ``wanted`` by descending score, then ascending id."""
    if len(score) > 4 * wanted:
        floor = np.partition(score, len(score) - wanted)[len(score) - wanted]
        some = np.flatnonzero(score >= floor)
        return some[np.lexsort((ids[some], -score[some]))[:wanted]]
    return np.lexsort((ids, -score))[:wanted]


class Walk:
    """Scores of one tile along the tree. ``asks(k)`` has the eligible rows and the windows of anchor k."""

    def __init__(self, anchors: Block, rows: Block) -> None:
        self.a, self.c = anchors, rows
        width = anchors.q.shape[1]
        self.exact = anchors.largest * rows.largest * max(width, 1) < 2.0**53
        self.norm = np.sqrt((rows.q * rows.q).sum(axis=1))
        self.rescored = 0
        if not self.exact:
            self.ia, self.ic = (self._integers(x.q) for x in (anchors, rows))

    @staticmethod
    def _integers(q: np.ndarray) -> np.ndarray:
        if not q.size or np.abs(q).max() < 2.0**63:
            return q.astype(np.int64)
        return np.array([[((int(x) + 2**63) % 2**64) - 2**63 for x in row] for row in q.tolist()], np.int64)

    def score(self, k: int, at: np.ndarray) -> np.ndarray:
        self.rescored += len(at)
        if not self.exact:
            return (self.ic[at] * self.ia[k]).sum(axis=1)
        if 2 * len(at) > len(self.c.q):
            return (self.c.q @ self.a.q[k])[at]
        return self.c.q[at] @ self.a.q[k]

    def run(self, asks: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]], wanted: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, positions, scores) of the best rows in each of the windows [lo, hi] of an anchor."""
        tree = spanning_tree(self.a.q) if self.exact else [(k, -1, 0.0) for k in range(len(self.a.q))]
        waiting = np.bincount([p for _, p, _ in tree if p >= 0], minlength=len(tree))
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, parent, edge in tree:
            eligible, lo, hi = asks(k)
            floors = lo.astype(np.float64)
            if parent < 0:
                low, high = np.full(len(self.norm), -np.inf), np.full(len(self.norm), np.inf)
            else:
                low, high, seeds = kept[parent]
                slack = edge * self.norm * (1 + 1e-9) + 1.0
                low, high = low - slack, high + slack
                seeds = seeds[eligible[seeds]]
                seen = self.score(k, seeds)
                for w in range(len(lo)):
                    inside = np.sort(seen[(seen >= lo[w]) & (seen <= hi[w])])
                    if len(inside) >= wanted:
                        floors[w] = inside[-wanted]
                waiting[parent] -= 1
                if not waiting[parent]:
                    del kept[parent]
            open_ = np.zeros(len(self.norm), bool)
            for w in np.flatnonzero(floors <= hi):
                open_ |= (high >= floors[w]) & (low <= hi[w])
            at = np.flatnonzero(open_ & eligible)
            score = self.score(k, at)
            low[at] = high[at] = score
            chosen = [np.empty(0, np.int64)]
            for w in range(len(lo)):
                inside = np.flatnonzero((score >= lo[w]) & (score <= hi[w]))
                if len(inside):
                    first = inside[best(score[inside], self.c.id[at[inside]], wanted)]
                    chosen.append(at[first])
                    yield k, w, at[first], score[first].astype(np.int64)
            if waiting[k]:
                kept[k] = low, high, np.unique(np.concatenate(chosen))


def _tiles(work: Callable[[Block, Block], Iterator[tuple[int, ...]]], known: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                rows = list(work(Block(t["a_size"], t["width"], t["a"], known), Block(t["c_size"], t["width"], t["c"])))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def positives_of(wanted: int):
    def work(a: Block, c: Block) -> Iterator[tuple[int, ...]]:
        def asks(k: int):
            return (c.label == a.label[k]) & (c.row != a.row[k]), np.array([LOWEST]), np.array([LAST])

        for k, _, at, score in Walk(a, c).run(asks, wanted):
            for i, s in zip(at.tolist(), score.tolist(), strict=True):
                yield int(a.row[k]), int(c.row[i]), int(c.id[i]), s

    return work


def negatives_of(wanted: int, low: int, high: int):
    def work(a: Block, c: Block) -> Iterator[tuple[int, ...]]:
        def asks(k: int):
            p = [int(x) for x in a.known[:, k]]
            empty = [x == LAST or x < 0 for x in p]
            lo = [0 if e else -(-low * x // 100) for x, e in zip(p, empty, strict=True)]
            hi = [-1 if e else high * x // 100 for x, e in zip(p, empty, strict=True)]
            return c.label != a.label[k], np.array(lo, np.int64), np.array(hi, np.int64)

        for k, w, at, score in Walk(a, c).run(asks, wanted):
            for i, s in zip(at.tolist(), score.tolist(), strict=True):
                yield int(a.row[k]), w + 1, int(c.id[i]), s

    return work


def _side(v: Column, width: int, plane: int) -> Column:
    """Which side of a random plane a vector lies on."""
    normal = np.random.default_rng([7, width, plane]).normal(size=width).tolist()
    terms = F.zip_with(v, F.array(*[F.lit(x) for x in normal]), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) >= 0


def _against(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of anchors with every block of candidates, as a product of the stored partitions.

    Spark reads the tables once more for each pair of partitions; no block is copied for a shuffle or sent to the
    driver, as a join on a slot would do once its small estimate let Spark broadcast the anchors of all slots.
    """
    a = blocks.select("width", F.col("size").alias("a_size"), F.col("packed").alias("a"))
    c = candidates.select(F.col("size").alias("c_size"), F.col("packed").alias("c"))
    return c.hint("shuffle_replicate_nl").crossJoin(a).select("width", "a_size", "a", "c_size", "c")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         candidates: int = CANDIDATES, anchors: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, positive_nth, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` and ``label`` are expressions over ``vec_id`` and ``label``.
    """
    v = F.col("embedding").cast("array<double>")
    taken = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = taken.filter("label is not null and v is not null").filter(sound)
    taken = store(taken.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_anchors, width = taken.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, positive_nth int, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    slots, parts = parts_for(n, candidates), parts_for(n_anchors, anchors)
    numbered = lambda df: df.withColumn("part", F.spark_partition_id().cast("long"))
    rows = store(numbered(taken.drop("is_anchor").repartition(slots)).mapInArrow(_pack(width, candidates, []), BLOCK), "candidates")
    sides = sum((_side(F.col("v"), width, k).cast("int") * (1 << k) for k in range(PLANES)), F.lit(0)) if width else F.lit(0)
    own = taken.filter("is_anchor").drop("is_anchor").withColumn("side", sides)
    own = store(numbered(own.repartitionByRange(parts, "label", "side", "row").sortWithinPartitions("label", "side", "row")), "anchors")
    blocks = store(own.mapInArrow(_pack(width, anchors, []), BLOCK), "anchor-blocks")
    found = _against(blocks, rows).mapInArrow(_tiles(positives_of(n_positives), 0, ["anchor", "row", "id", "score"]), "anchor long, row long, id long, score long")
    ranks = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
    positives = found.withColumn("nth", F.row_number().over(ranks)).filter(F.col("nth") <= n_positives)
    positives = store(positives.select("anchor", "nth", "id", "score"), "positives")
    asked = positives.groupBy("anchor").agg(*[F.max(F.when(F.col("nth") == k, F.col("score"))).alias(f"p{k}") for k in range(1, n_positives + 1)])
    own = own.join(asked, own["row"] == asked["anchor"]).drop("anchor")
    known = [f"p{k}" for k in range(1, n_positives + 1)]
    # one task for each part, in the order that put neighbours together
    own = own.repartition(parts, "part").sortWithinPartitions("part", "label", "side", "row")
    blocks = store(own.mapInArrow(_pack(width, anchors, known), BLOCK), "asking-blocks")
    found = _against(blocks, rows).mapInArrow(_tiles(negatives_of(n_negatives, low, high), n_positives, ["anchor", "nth", "id", "score"]), "anchor long, nth long, id long, score long")
    ranks = Window.partitionBy("anchor", "nth").orderBy(F.col("score").desc(), "id")
    negatives = found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= n_negatives)
    negatives = negatives.select("anchor", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.withColumnRenamed("score", "positive_score").join(negatives, ["anchor", "nth"])
    named = taken.filter("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    given = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    out = out.withColumnRenamed("id", "positive_id").join(named, "anchor")
    return out.select("anchor_id", given("positive_id"), F.col("nth").cast("int").alias("positive_nth"), F.col("rank").cast("int").alias("rank"), given("negative_id"), "positive_score", "negative_score")
