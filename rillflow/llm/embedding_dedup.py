"""Near-duplicate vectors by lattice hashing.

1. *Nodes.* Rows with the same vector are one node with a weight; copies cost nothing from here on.
2. *Cells.* In each of ``tables`` tables a random Gaussian projection takes the unit vector to ``blocks``
   times eight numbers, each block is decoded to its nearest point of the E8 lattice, and the points
   together are the node's cell. A node also probes the neighbouring cells: of the sums of minimal lattice
   vectors over the blocks the ``probes - 1`` whose points lie nearest to the projection.
3. *Groups.* In a cell that is somebody's own, the smallest owner is the centre, and everybody there joins
   the centre's group. Two nodes that meet in any cell meet in the group of its centre, so nothing is lost,
   and a node joins a few groups instead of one for every table and probe.
4. *Verification.* A group is dealt in chunks, and every pair of chunks is a tile of its own, so a group
   with a third of all rows is spread over many tasks. A tile multiplies blocks of unit vectors and gives
   one row per linked node: the weight of its links and the smallest node its links inside the tile lead to.
   A pair that shares several groups counts in the one with the smallest centre. No pair leaves a tile.
5. *Components* join by stars over those rows.

A cosine is a double; pairs within 1e-9 of the threshold are computed again from the plain vectors. Every
link returned is verified. A pair at cosine 0.95 misses all cells with a probability of about 0.02, one at
0.97 with less than 0.001 (measured in the tests).

A NULL or zero vector, an empty one, and one with a NULL or non-finite component link with nothing: no
links, a component of their own. Vectors of different lengths do not link. Rows that repeat an id are rows
of their own; they link with each other if their vectors do, and are kept if their id is their component's
smallest. A NULL id never names a component unless nothing else does. An empty table gives an empty
result. Columns other than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.near_dedup import components
from rillflow.scratch import store

COSINE = 0.95
TABLES, BLOCKS, SCALE, PROBES = 8, 2, 0.75, 12
#: Members of a group that share a chunk, rows of a tile multiplied at once, neighbours of a block looked at.
CHUNK, SIDE, NEAREST = 4096, 1024, 10
SEED = 20_24


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or eight of one half with an even number of signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(np.sign(s)) > 0]
    return np.array(out)


STEPS = _minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is the even integer points and their shift by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


class Lattice:
    """Cells of unit vectors, own one first, for every table."""

    def __init__(self, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES) -> None:
        self.tables, self.blocks, self.scale, self.probes = tables, blocks, scale, probes
        self.turned: dict[int, np.ndarray] = {}

    def _projection(self, width: int) -> np.ndarray:
        if width not in self.turned:
            self.turned[width] = np.random.default_rng([SEED, width]).normal(size=(self.tables, self.blocks, width, 8)) * self.scale
        return self.turned[width]

    def _hashed(self, table: int, width: int, points: np.ndarray) -> np.ndarray:
        h = np.full(points.shape[:-1], np.uint64(width * 4096 + table + 1))
        for k in range(points.shape[-1]):
            h = (h ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, probes)"""
        n, width = unit.shape
        out = np.empty((n, self.tables, self.probes), np.int64)
        for t, projection in enumerate(self._projection(width)):
            cost = np.zeros((n, 1))
            points = np.zeros((n, 1, 0))
            for p in projection:
                x = unit @ p
                own = nearest_e8(x)
                away = 2.0 - 2.0 * ((x - own) @ STEPS.T)  # squared distance of a neighbour less that of the own point
                near = np.argpartition(away, NEAREST, axis=1)[:, :NEAREST]
                options = np.concatenate([own[:, None], own[:, None] + STEPS[near]], axis=1)
                extra = np.concatenate([np.zeros((n, 1)), np.take_along_axis(away, near, axis=1)], axis=1)
                both = (cost[:, :, None] + extra[:, None, :]).reshape(n, -1)
                best = np.argsort(both, axis=1, kind="stable")[:, : self.probes]
                cost = np.take_along_axis(both, best, axis=1)
                left = np.take_along_axis(points, (best // options.shape[1])[:, :, None], axis=1)
                points = np.concatenate([left, np.take_along_axis(options, (best % options.shape[1])[:, :, None], axis=1)], axis=2)
            out[:, t] = self._hashed(t, width, points)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def _placed(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, widths = batch.column("node").to_numpy(), batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                v = _matrix(batch.column("v").take(pa.array(rows)))
                cells = lattice.cells(_unit(v))
                own = np.zeros(cells.shape, bool)
                own[:, :, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel()), pa.array(np.repeat(nodes[rows], cells.shape[1] * cells.shape[2])), pa.array(own.ravel())],
                    names=["cell", "node", "own"],
                )

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that the links lead to, for each of ``n`` indexes."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (before == least).all():
            return least


class Tile:
    """Links between the rows of two chunks of one group, or inside one chunk."""

    def __init__(self, cosine: float) -> None:
        self.cosine = cosine

    def _shared(self, earlier: list[list[int]]) -> np.ndarray | None:
        """Which groups with a smaller centre a row is in, one column for each that two rows are in."""
        flat = np.fromiter(itertools.chain.from_iterable(earlier), np.int64)
        if not len(flat):
            return None
        groups, column, held = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.cumsum(held > 1) - 1
        rows = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier])
        wanted = held[column] > 1
        if not wanted.any():
            return None
        out = np.zeros((len(earlier), common[-1] + 1), np.float32)
        out[rows[wanted], common[column[wanted]]] = 1
        return out

    def links(self, v: np.ndarray, earlier: list[list[int]], first: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs. ``first``: rows of the first chunk, which come first; all rows if the tile has one chunk."""
        unit, n = _unit(v), len(v)
        shared = self._shared(earlier)
        one = first == n
        found = []
        for i in range(0, first, SIDE):
            for j in range(i if one else first, n, SIDE):
                top = min(i + SIDE, first)
                close = unit[i:top] @ unit[j : j + SIDE].T >= self.cosine - 1e-9
                if shared is not None and close.any():
                    close &= shared[i:top] @ shared[j : j + SIDE].T == 0
                a, b = np.nonzero(close)
                a, b = a + i, b + j
                if i == j:
                    a, b = a[a < b], b[a < b]
                found.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        close = np.einsum("ij,ij->i", unit[a], unit[b])
        for k in np.flatnonzero(np.abs(close - self.cosine) <= 2e-9).tolist():
            x, y = v[a[k]], v[b[k]]
            close[k] = (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())
        real = close >= self.cosine
        return a[real], b[real]


def _verified(cosine: float):
    """Rows sorted by tile and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = Tile(cosine)
        held: list[pa.RecordBatch] = []

        def flush(keep: bool) -> Iterator[pa.RecordBatch]:
            """Works on the whole tiles held; with ``keep`` the last one waits for more rows."""
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            key = np.stack([table.column(c).to_numpy() for c in ("centre", "lo", "hi")])
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
            if keep:
                held.extend(table.slice(starts[-2]).to_batches())
                starts = starts[:-1]
            if len(starts) < 2:
                return
            table = table.slice(0, starts[-1])
            nodes, weights, chunks = (table.column(c).to_numpy() for c in ("node", "weight", "chunk"))
            earlier, vectors = table.column("earlier").to_pylist(), table.column("v").combine_chunks()
            out = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2:
                    continue
                first = int(np.count_nonzero(chunks[s:e] == key[1, s]))
                if key[1, s] != key[2, s] and first in (0, e - s):
                    continue  # a chunk that got no row
                a, b = tile.links(_matrix(vectors.slice(s, e - s)), earlier[s:e], first)
                if not len(a):
                    continue
                links = np.bincount(a, weights[s:e][b], e - s) + np.bincount(b, weights[s:e][a], e - s)
                own = nodes[s:e]
                order = np.argsort(own, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                least = own[order[_least_reachable(e - s, place[a], place[b])[place]]]
                some = links > 0
                out.append((own[some], links[some].astype(np.int64), least[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "links", "least"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from flush(True)
                rows = 0
        if held:
            yield from flush(False)

    return run


def near_duplicates(vectors: DataFrame, lattice: Lattice | None = None, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row."""
    lattice = lattice or Lattice()
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0), F.lit(False))
    # minus zero is zero; a tag over the content names equal vectors
    plain = plain.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))
    spelled = F.to_json(F.struct("v"))
    plain = store(plain.withColumn("tag", F.when(F.col("v").isNotNull(), F.sha2(spelled.cast("binary"), 256))), "vectors")
    sorts = plain.filter("tag is not null").groupBy("tag").agg(F.min("vec_id").alias("min_id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    nodes = store(sorts.select(F.monotonically_increasing_id().alias("node"), "tag", "min_id", "weight", "v", F.size("v").alias("width")), "nodes")
    entries = store(nodes.select("node", "v", "width").mapInArrow(_placed(lattice), "cell long, node long, own boolean"), "cells")
    # the centre of a cell is its smallest owner; a cell with one node or without an owner links nothing
    centres = entries.groupBy("cell").agg(
        F.min(F.when(F.col("own"), F.col("node"))).alias("centre"), F.min("node").alias("a"), F.max("node").alias("b")
    ).filter("centre is not null and a < b").select("cell", "centre")
    members = store(entries.select("cell", "node").join(centres, "cell").select("centre", "node").distinct(), "members")
    sizes = members.groupBy("centre").agg(F.count("*").alias("held")).select("centre", F.ceil(F.col("held") / F.lit(chunk)).cast("int").alias("chunks"))
    joined = members.groupBy("node").agg(F.sort_array(F.collect_set("centre")).alias("centres"))  # at most tables * probes
    joined = joined.join(nodes.select("node", "weight", "v"), "node").select("node", "weight", "v", "centres", F.explode("centres").alias("centre"))
    joined = joined.withColumn("earlier", F.filter("centres", lambda c: c < F.col("centre"))).drop("centres")
    dealt = joined.join(sizes, "centre").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = dealt.select("centre", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "weight", "v", "earlier")
    tiles = tiles.repartition("centre", "lo", "hi").sortWithinPartitions("centre", "lo", "hi", "chunk")
    found = store(tiles.mapInArrow(_verified(cosine), "node long, links long, least long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    named = nodes.select("tag", "node", "min_id", "weight").join(links, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    named = named.join(names, "comp").select("tag", n_links, "component_id")
    linked = plain.select("vec_id", "tag").filter("tag is not null").join(named, "tag").select("vec_id", "n_links", "component_id")
    alone = plain.filter("tag is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
