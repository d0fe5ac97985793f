import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from rillflow.llm import exact_dedup, near_dedup

from tests.llm.helpers import CLASHES, awkward, awkward_rows, empty, plain_rows, words


@pytest.mark.parametrize(("table_bytes", "bucket_bytes"), [(1 << 20, 1 << 20), (500, 3000)])
def test_exact_decisions_equal_brute_force(spark, table_bytes, bucket_bytes):
    decisions, kept = exact_dedup.grace_dedup(awkward(spark), table_bytes, bucket_bytes)
    groups = defaultdict(list)
    for doc_id, text, *_ in awkward_rows():
        groups[text or ""].append(doc_id)
    got = defaultdict(list)
    for r in decisions.collect():
        got[r["text_sha256"]].append(r)
    assert len(got) == len(groups)
    for text, ids in groups.items():
        rows = got[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(repr, ids)) == sorted(repr(r["doc_id"]) for r in rows)
        assert {r["keep_id"] for r in rows} == {best} and {r["group_size"] for r in rows} == {len(ids)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]
    assert kept.columns == awkward(spark).columns
    assert sorted(map(repr, kept.select("doc_id", "text", "n_chars").collect())) == sorted(
        {repr(r) for r in awkward(spark).select("doc_id", "text", "n_chars").collect() if r["doc_id"] == max((i for i in groups[r["text"] or ""] if i is not None), default=None)}
    )


def test_exact_on_an_empty_table(spark):
    decisions, kept = exact_dedup.grace_dedup(empty(spark))
    assert decisions.count() == 0 and kept.count() == 0 and kept.columns == empty(spark).columns


def test_equal_hashes_do_not_join_texts():
    table = exact_dedup.ContentTable()
    assert table.find_or_add(5, b"a") == (0, True) and table.find_or_add(5, b"b") == (1, True)
    assert table.find_or_add(5, b"a") == (0, False)
    for i in range(5000):
        table.find_or_add(i % 7, str(i).encode())
    assert all(table.find_or_add(i % 7, str(i).encode())[1] is False for i in range(5000))


def shingles(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))


def brute_components(rows):
    sets = [(doc_id, shingles(text)) for doc_id, text in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i in range(len(sets)):
        names[find(i)].append(sets[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    out = []
    for i, (doc_id, s) in enumerate(sets):
        comp = smallest[find(i)] if s else doc_id
        out.append((doc_id, len(s), comp, doc_id == comp))
    return sorted(out, key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    out = near_dedup.near_duplicates(awkward(spark)).select("doc_id", "n_shingles", "component_id", "kept")
    assert plain_rows(out) == brute_components(rows)
    kept = near_dedup.keep_one(awkward(spark))
    assert set(CLASHES) <= set(kept.columns)
    assert near_dedup.keep_one(empty(spark)).count() == 0


def chain_rows():
    """Sliding windows over one text: neighbours are similar, ends are not; and variants of one base."""
    rng = random.Random(3)
    text = [f"w{rng.randrange(4000)}" for _ in range(900)]
    rows = [(1000 - i, " ".join(text[4 * i : 4 * i + 120])) for i in range(150)]
    base = [f"v{rng.randrange(4000)}" for _ in range(150)]
    for i in range(120):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(t)))
    return rows


@pytest.mark.parametrize("chunk", [4096, 20])
def test_chains_and_hubs_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    df = spark.createDataFrame(chain_rows(), "doc_id long, text string").repartition(4)
    out = near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")
    assert plain_rows(out) == brute_components(chain_rows())


def test_rows_that_repeat_id_and_text_make_one_node(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base)] * 200 + [(2, base + " tail")] * 200 + [(3, "other words altogether here now")] * 3
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()} == {(1, 56, 1, True), (2, 57, 1, False), (3, 1, 3, True)}
    assert out.count() == 403


def test_bound_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    for size in (3, 12, 60, 400, 3000):
        lost = 0
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 62, 7 * size).astype(np.uint64))
            x, y = a, a[: max(1, -(-3 * len(a) // 4))]
            share = (near_dedup.signature(x).astype(np.uint8) == near_dedup.signature(y).astype(np.uint8)).mean()
            lost += share < near_dedup.bound(np.array([float(len(y))]))[0]
        assert lost == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 40, 3000):
        same = []
        for _ in range(60):
            a = rng.integers(0, 1 << 62, 4 * size).astype(np.uint64)
            x, y = np.unique(a[: 3 * size]), np.unique(np.r_[a[:size], a[size * 2 :]][: 3 * size])
            truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            same.append((near_dedup.signature(x) == near_dedup.signature(y)).mean() - truth)
        assert abs(np.mean(same)) < 0.04
