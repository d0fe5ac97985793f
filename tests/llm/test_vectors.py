"""Hard negatives and near-duplicate vectors against brute force."""

import math
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from rillflow.llm import embedding_dedup, hard_negatives

from tests.llm.helpers import CLASHES, plain_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(n=260, width=8, seed=3):
    """Clusters of near and exact copies, ties, and every unsound row there is."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = base[i % 12] + rng.normal(size=width) * (0.02 if i % 3 else 0.6)
        if i % 17 == 0:
            v = base[i % 12]
        rows.append((i, [single(x) for x in v], int(i % 4)))
    rows += [rows[0], rows[50], rows[50], (300, rows[10][1], 2), (350, rows[10][1], 2), (None, rows[20][1], 1), (None, rows[21][1], 0)]
    rows += [(400, None, 1), (450, [], 1), (451, [0.0] * width, 2), (452, [1.0, None] + [0.5] * (width - 2), 1), (453, [math.nan] * width, 1)]
    rows += [(454, [math.inf] + [0.0] * (width - 1), 1), (455, rows[5][1], None), (456, [2.0, 1.0], 3), (457, [4.0, 2.0], 3), (500, [-0.0] + [1.0] * (width - 1), 3), (501, [0.0] + [1.0] * (width - 1), 3)]
    return rows


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, every=50):
    last = float("inf")
    rows = [(k, i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for k, (i, v, y) in enumerate(rows) if y is not None and sound(v)]
    out = []
    for k, i, q, y in rows:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r, strict=False)), last if j is None else j, m, z) for m, j, r, z in rows if m != k)
        for s, j, _, _ in [x for x in scored if x[3] == y][:5]:
            fits = [x for x in scored if x[3] != y and -50 * s <= -100 * x[0] <= -95 * s]
            out += [(i, None if j == last else j, nth, None if x[1] == last else x[1], -s, -x[0]) for nth, x in enumerate(fits[:3], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("candidates", "anchors"), [(4096, 256), (40, 3)])
def test_negatives_equal_brute_force(spark, candidates, anchors):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors()
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, moved, candidates=candidates, anchors=anchors)
    got = plain_rows(got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    want = brute_negatives(rows, 10)
    assert len(want) > 200 and got == want


def test_negatives_of_huge_components_and_of_nothing(spark):
    rows = [(50 * k, [float(2**21 + k), 1.5 * k, -3.0], k % 2) for k in range(12)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), low=0, high=100)
    want = []
    q = {i: [math.floor(256 * single(x)) for x in v] for i, v, _ in rows}
    score = lambda a, b: sum(x * y for x, y in zip(q[a], q[b], strict=True))
    for i, _, y in rows:
        for p in sorted((j for j, _, z in rows if z == y and j != i), key=lambda j: (-score(i, j), j))[:5]:
            s = score(i, p)
            fits = sorted((j for j, _, z in rows if z != y and 0 <= score(i, j) <= s), key=lambda j: (-score(i, j), j))[:3]
            want += [(i, p, n, j, s, score(i, j)) for n, j in enumerate(fits, 1)]
    assert plain_rows(got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) == sorted(want, key=repr)
    none = hard_negatives.mine(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0, F.col("label"))
    assert none.count() == 0 and none.columns == got.columns
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1), (50, [1.0], 2)]), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def broadcast_types(df):
    """Types of the columns that a plan sends through the driver to all executors."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("BroadcastExchange"):
            out += [c.dataType().typeName() for c in (node.output().apply(i) for i in range(node.output().size()))]
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_no_block_of_vectors_is_broadcast(spark):
    rows = vectors(600)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), candidates=40, anchors=3)
    small = spark.createDataFrame([(1, b"x")], "a long, b binary").hint("broadcast")
    assert "binary" in broadcast_types(spark.range(3).join(small, F.col("id") == F.col("a")))
    assert "binary" not in broadcast_types(got)


def test_bounds_leave_rows_of_clusters_out_and_lose_none():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 32)) * 10
    rows = np.floor(256 * np.concatenate([b + rng.normal(size=(60, 32)) * 0.01 for b in base]))
    ids, labels = np.arange(len(rows)), np.repeat(np.arange(6), 60) % 2
    packed = lambda at: hard_negatives.Block(len(at), 32, np.stack([at, ids[at], labels[at]]).astype("<i8").tobytes() + rows[at].astype("<f8").tobytes())
    a, c = packed(ids[::5]), packed(ids)
    walk = hard_negatives.Walk(a, c)
    asks = lambda k: ((c.label == a.label[k]) & (c.row != a.row[k]), np.array([-(2**62)]), np.array([2**62]))
    exact = rows[::5] @ rows.T
    for k, _, at, score in walk.run(asks, 5):
        fits = sorted(((-exact[k, j], j) for j in range(len(rows)) if labels[j] == a.label[k] and j != a.row[k]))[:5]
        assert list(zip((-score).tolist(), at.tolist(), strict=True)) == fits
    assert walk.rescored < 0.5 * len(a.q) * len(rows) / 2


def brute_links(rows, cosine=0.95):
    n = len(rows)
    fine = [k for k, (_, v, _) in enumerate(rows) if sound(v) and any(v)]
    links, parent = defaultdict(int), list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, a in enumerate(fine):
        for b in fine[x + 1 :]:
            u, v = rows[a][1], rows[b][1]
            if len(u) == len(v) and sum(p * q for p, q in zip(u, v, strict=True)) / math.sqrt(sum(p * p for p in u) * sum(q * q for q in v)) >= cosine:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    names = defaultdict(list)
    for k in range(n):
        names[find(k)].append(rows[k][0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        least = min((x for x in names[find(k)] if x is not None), default=None)
        out.append((i, links[k], least, i == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_vector_links_equal_brute_force(spark, chunk):
    rows = vectors()
    got = plain_rows(embedding_dedup.near_duplicates(frame(spark, rows), chunk=chunk))
    assert got == brute_links(rows) and max(r[1] for r in got) > 5


def test_vectors_of_an_empty_table(spark):
    out = embedding_dedup.near_duplicates(frame(spark, vectors()).limit(0))
    assert out.count() == 0 and out.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_nearest_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    near = embedding_dedup.nearest_e8(x)
    assert ((2 * near) % 1 == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    away = ((x - near) ** 2).sum(axis=1)
    assert (away <= 1 + 1e-9).all()  # the covering radius
    others = ((x[:, None] - near[:, None] - embedding_dedup.STEPS[None]) ** 2).sum(axis=2)
    assert (others >= away[:, None] - 1e-9).all() and len(np.unique(embedding_dedup.STEPS, axis=0)) == 240


@pytest.mark.parametrize(("cosine", "least"), [(0.95, 0.95), (0.97, 0.998), (0.99, 0.9999)])
def test_share_of_similar_pairs_that_meet(cosine, least):
    rng = np.random.default_rng(2)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1)[:, None] * u
    v = cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1)[:, None]
    lattice = embedding_dedup.Lattice()
    a, b = lattice.cells(u), lattice.cells(v)
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= least
    strangers = (a[:2000] == b[2000:, :, :1]).any(axis=(1, 2))
    assert strangers.mean() < 0.002
