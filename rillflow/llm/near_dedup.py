"""MinHash near-deduplication: one-permutation hashing, optimal densification, star edges.

1. *Sets.* Every text becomes its set of distinct five-word shingles (64-bit hashes). One
   permutation sorts the hashes into ``BANDS * ROWS`` bins that keep their minimum; an empty
   bin copies a filled one chosen by a hash of (bin, attempt), the same for all documents.
   Documents with equal sets form one *node*; copies cost nothing from here on.
2. *Buckets.* ``ROWS`` bins make a band, a band's value is a bucket. A pair at similarity
   0.75 misses all buckets with probability 4e-6.
3. *Stars.* The smallest node of a bucket is its centre, and the only candidate edges are those
   from members to centres, of which a node has at most ``BANDS``. Nodes that meet in a bucket
   meet in the group of its centre, so a pair is never a row of its own.
4. *Tiles.* A group comes to a task with its sets, in chunks of bounded size that all hold the
   centre. There nodes are joined: the bytes of the minima that agree tell which pairs may be
   similar (a pair at the threshold lies ``SIGMAS`` standard deviations above the bound), those
   are tested on complete sets, and pairs that are already in one component are not. Only the
   smallest node of its component comes back for a node.
5. *Large groups.* Where a group has several chunks, what its largest component has not yet
   taken in meets all its members, again in tiles. Nothing is capped.

A test compares complete sets, ``100 * intersection >= 75 * union``.

NULL, empty or wordless text: empty set, linked with nothing. Rows that repeat a ``doc_id``
are each judged by their own text; a row is kept if its id is its component's smallest.
Rows without id never give a component its name unless no row has an id. Texts of any length
are taken whole; the bytes of their sets bound a chunk. An empty table gives an empty result.
Column names other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.caching import giving_back
from rillflow.scratch import store

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 64, 6
BINS = BANDS * ROWS
WORD_CACHE = 300_000
#: Nodes and bytes of sets in a chunk.
CHUNK, CHUNK_BYTES = 4096, 24 << 20
#: Standard deviations between the threshold and the share of agreeing minima below which a pair is not tested.
SIGMAS = 6.0

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return (x ^ (x >> np.uint64(32))) * _ODD


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > WORD_CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, len(words) if len(words) < SHINGLE else 0, np.uint64)
        for k in range(min(SHINGLE, len(h))):
            out = _mix(out ^ h[k : k + n]) + _ODD
        return np.unique(out)


_ATTEMPTS = [_mix(np.arange(BINS, dtype=np.uint64) * np.uint64(4096) + np.uint64(t + 1)) % np.uint64(BINS) for t in range(48)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a non-empty set, densified."""
    scrambled = _mix(shingles + _MIX)
    bins = ((scrambled >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bins.astype(np.int64), _mix(scrambled))
    filled = np.zeros(BINS, bool)
    filled[bins.astype(np.int64)] = True
    empty = np.flatnonzero(~filled)
    for attempt in _ATTEMPTS:
        if not len(empty):
            return out
        source = attempt[empty].astype(np.int64)
        good = filled[source]
        out[empty[good]] = out[source[good]]
        empty = empty[~good]
    if len(empty):  # few filled bins: the one with the smallest hash of (bin, filled bin)
        have = np.flatnonzero(filled)
        order = _mix(empty[:, None].astype(np.uint64) * np.uint64(BINS) + have[None, :].astype(np.uint64) + _ODD)
        out[empty] = out[have[order.argmin(axis=1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    grid = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out ^ grid[:, k]) + _ODD
    return out.view(np.int64)


@giving_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        n, k1, k2, bands, minima = [], [], [], [], []
        for text in batch.column("text"):
            found = shingler(text.as_py())
            n.append(len(found))
            digest = xxhash.xxh3_128_digest(found.tobytes())
            k1.append(int.from_bytes(digest[:8], "little", signed=True))
            k2.append(int.from_bytes(digest[8:], "little", signed=True))
            mins = signature(found) if len(found) else None
            bands.append(band_keys(mins) if mins is not None else np.empty(0, np.int64))
            minima.append(mins.astype(np.uint8).tobytes() if mins is not None else b"")
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(minima, pa.binary())],
            names=["doc_id", "th", "n", "k1", "k2", "bands", "minima"],
        )


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Both sorted and distinct."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


@giving_back
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        found = [shingler(text.as_py()).tobytes() for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])


def bound(sizes: np.ndarray) -> np.ndarray:
    """Share of agreeing minima that a pair at the threshold practically reaches, by the size of its smaller set."""
    filled = BINS * -np.expm1(-sizes / BINS)
    share = PERCENT / 100
    return share - SIGMAS * np.sqrt(share * (1 - share) / np.maximum(filled, 1.0))


def join_similar(sets: list[np.ndarray], minima: np.ndarray, labels: np.ndarray, first: int | None = None) -> np.ndarray:
    """``labels`` after every pair of similar sets with different labels is joined, under the smaller label.

    With ``first``, only pairs of one of the first sets with one of the others count.
    """
    labels = labels.copy()
    sizes = np.array([len(x) for x in sets], np.float64)
    least = bound(sizes)
    for c in range(len(sets) if first is None else first):
        others = np.arange(c + 1 if first is None else first, len(sets))
        others = others[labels[others] != labels[c]]
        fits = 100 * np.minimum(sizes[others], sizes[c]) >= PERCENT * np.maximum(sizes[others], sizes[c])
        others = others[fits]
        if not len(others):
            continue
        share = (minima[others] == minima[c]).mean(axis=1)
        likely = share >= np.minimum(least[others], least[c])
        for k in others[likely][np.argsort(-share[likely], kind="stable")].tolist():
            if labels[k] != labels[c] and similar(sets[c], sets[k]):
                low, high = sorted((int(labels[c]), int(labels[k])))
                labels[labels == high] = low
    return labels


@giving_back
def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile (centre, outer, chunk). Gives every node whose component changed with its new one.

    Rows have the component known so far; ``side`` 0 marks rows that meet those with side 1, without it all meet.
    """
    key, rows = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: (r[0] or 0, r[1]))
        nodes, comps = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        minima = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), BINS)
        first = None if rows[0][0] is None else sum(r[0] == 0 for r in rows)
        after = join_similar(sets, minima, comps, first)
        new = after != comps
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(after[new])], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("centre", "outer", "chunk", "side", "node", "comp")]
        for i, (centre, outer, chunk, side, node, comp) in enumerate(zip(*columns, strict=True)):
            if (centre, outer, chunk) != key:
                yield from flush()
                key, rows = (centre, outer, chunk), []
            rows.append((side, node, comp, batch.column("hashes")[i].as_py(), batch.column("minima")[i].as_py()))
    yield from flush()


def in_tiles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows``: centre, outer, chunk, side, node, comp. Gives links (a, b) between components."""
    rows = rows.join(sets, "node").repartition("centre", "outer", "chunk").sortWithinPartitions("centre", "outer", "chunk")
    return store(rows.select("centre", "outer", "chunk", "side", "node", "comp", "hashes", "minima").mapInArrow(_tiles, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node reachable) of every node of ``edges`` (a, b).

    Alternates large and small stars; neighbourhoods are only ever reduced to their minimum.
    """
    links = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = store(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = store(small.filter("a <> b").distinct(), "small-star")
        # done when no node has two parents and no parent has one
        parents = after.select(F.col("b").alias("a")).distinct()
        deeper = after.join(parents, "a", "left_semi")
        twice = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        links = after
        if deeper.select("a").unionByName(twice.select("a")).isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("comp"))
    )


def _dealt(rows: DataFrame, by: str, into: str, chunks: str) -> DataFrame:
    return rows.withColumn(into, F.pmod(F.xxhash64(by), F.col(chunks)).cast("int"))


def linked_nodes(live: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, comp`` of linked nodes. ``live``: bucket, node, of buckets with two nodes or more; ``sets``: node, hashes, minima."""
    centres = live.groupBy("bucket").agg(F.min("node").alias("centre"))
    members = live.join(centres, "bucket").select("centre", "node").distinct()
    members = store(members.join(sets.select("node", F.octet_length("hashes").alias("bytes")), "node"), "members")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(CHUNK), F.sum("bytes") / F.lit(CHUNK_BYTES))).cast("int")
    sizes = store(members.groupBy("centre").agg(parts.alias("chunks")), "sizes")
    none = F.lit(None).cast("int")
    own = _dealt(members.filter("node <> centre").join(sizes, "centre"), "node", "chunk", "chunks").select("centre", "chunk", "node")
    hubs = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("centre").alias("node"))
    rows = own.unionByName(hubs).select("centre", F.lit(0).alias("outer"), "chunk", none.alias("side"), "node", F.col("node").alias("comp"))
    links = in_tiles(rows, sets)
    large = sizes.filter("chunks > 1")
    if large.isEmpty():
        return components(links)
    known = store(components(links), "components")
    spread = members.join(large, "centre").join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    spread = store(spread, "large")
    main = spread.groupBy("centre", "comp").agg(F.count("*").alias("held"))
    main = main.groupBy("centre").agg(F.max_by("comp", F.struct("held", "comp")).alias("main"))
    outside = spread.join(main, "centre").filter("comp <> main")
    outer = outside.groupBy("centre").agg(parts.alias("outers"))
    outside = _dealt(outside.join(outer, "centre"), "node", "outer", "outers").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    inside = _dealt(spread.join(outer, "centre"), "node", "chunk", "chunks").withColumn("outer", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)))
    columns = lambda side: ("centre", "outer", "chunk", F.lit(side).alias("side"), "node", "comp")
    more = in_tiles(outside.select(*columns(0)).unionByName(inside.select(*columns(1))), sets)
    joined = known.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)
    return components(joined)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n_shingles, component_id, kept``, one row per input row.

    ``th`` is ``xxhash64(coalesce(text, ''))``; with ``doc_id`` it tells rows apart.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    schema = "doc_id long, th long, n long, k1 long, k2 long, bands array<long>, minima binary"
    sets = store(slim.mapInArrow(_sets, schema), "sets")
    filled = sets.filter("n > 0")
    classes = filled.groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bands").alias("bands"), F.first("minima").alias("minima")
    )
    nodes = store(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1").select("bucket")
    live = store(placed.join(shared, "bucket"), "live")
    asked = live.select("node").distinct().join(nodes.select("node", "rep", "minima"), "node").select("node", "minima", "rep.doc_id", "rep.th")
    same = F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.th") == F.col("r.th"))
    texts = slim.alias("t").join(asked.alias("r"), same).select("r.node", "t.text").dropDuplicates(["node"])
    sets_of = store(texts.mapInArrow(_hashed, "node long, hashes binary"), "shingles")
    comps = linked_nodes(live, sets_of.join(asked.select("node", "minima"), "node"))
    named = nodes.select("node", "k1", "k2", "min_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    named = named.join(names, "comp").select("k1", "k2", "component_id")
    out = sets.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), F.when(F.col("n") > 0, F.col("k2")).alias("k2"))
    linked = out.filter("n > 0").join(named, ["k1", "k2"]).select("doc_id", "th", "n", "component_id")
    alone = out.filter("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns."""
    kept = near_duplicates(docs).filter("kept").select("doc_id", "th").distinct()
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_kept_th"))
    return docs.join(kept, same, "left_semi")
