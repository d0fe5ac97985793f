"""Fill-in-the-middle against regular expressions and the plain rule."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from rillflow.llm import fill_middle

from tests.llm.helpers import awkward, awkward_rows, empty, plain_rows, prose

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_rule(doc_id, text, seed=42):
    t = text or ""
    units = UNIT.findall(t)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def more_rows():
    odd = ["<", "<P", ">", "<S <M P> S>", "a <P> b", " lead", "trail ", "   x", "é" * 3000 + " " + "漢 " * 3000, "\n\n", "😀 " * 900]
    return [(1000 + 40 * k + j, t, "en", "a", 1) for k, t in enumerate(odd) for j in range(40)]


def check(spark, df, rows):
    out = fill_middle.fill_middle(df)
    got = plain_rows(out.select("record.doc_id", "record.text", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")))
    assert got == sorted([(i, t, *by_rule(i, t), t or "") for i, t, *_ in rows], key=repr)
    return out


def test_transformation_equals_the_rule(spark):
    rows = awkward_rows()
    out = check(spark, awkward(spark), rows)
    assert set(awkward(spark).columns) == set(out.schema["record"].dataType.names)


def test_odd_texts(spark):
    rows = more_rows()
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2), rows)


def test_empty_table(spark):
    assert fill_middle.fill_middle(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [97, 4 << 20])
def test_counts_and_cuts_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    texts = ["", " ", prose(3, 700), prose(4, 2) + "  ", "x" * 9000, prose(3, 700), " é " * 40, ""]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    joined = np.frombuffer(b"".join(data), np.uint8)
    cutter = fill_middle.Cutter()
    for draw in (0, 1, 5, 333, 4_000_000_007):
        n, (at,) = cutter(joined, offsets, [np.full(len(texts), draw, np.uint64)])
        units = [UNIT.findall(t) for t in texts]
        assert n.tolist() == [len(u) for u in units]
        assert at.tolist() == [len("".join(u[: draw % (len(u) + 1)])) for u in units]


def test_a_shared_passage_is_cut_alike_and_kept_once():
    passage = prose(9, 4000).encode()
    one, two = b"short opening " + passage, prose(11, 90).encode() + passage
    chunks = []
    for text in (one, two):
        data = np.frombuffer(text, np.uint8)
        cuts = fill_middle.boundaries(data, np.array([0, len(text)]))
        assert np.diff(cuts).max() <= fill_middle.LARGEST and (np.diff(cuts) > 0).all()
        chunks.append({text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)})
    assert sum(map(len, chunks[0] & chunks[1])) > 0.9 * len(passage)
    # equal length and ends, other content: the memo compares whole chunks
    memo = fill_middle.Cutter().memo
    assert [x[0] for x in memo([b"a b c", b"a bbc"])] == [2, 1]
