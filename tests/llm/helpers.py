"""Fixtures of the training-data tests: awkward tables and brute-force versions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("h", "size", "bucket", "n", "gid", "payload", "node", "target", "row", "record", "u", "key", "copies", "word", "ids", "start", "rest", "content", "kept", "k_id", "c", "m")
WORDS = "river stone under quiet light morning they were walking along with a small dog and some bread from town to see how far it goes".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 5 else str((x >> 12) % 50)))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "elsewhere"
    long = prose(2, 30_000)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 2),
        (3, " ".join(near), "en", "a", 3),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, " \t\n ", "de", "b", 4),
        (7, long, "en", "c", 5),
        (8, long, None, "c", 6),
        (9, "one two three", "en", None, 7),
        (10, "one two three", "en", None, 7),
        (10, "one two three", "en", None, 7),
        (None, base, "en", "a", 8),
        (None, None, None, None, None),
        (11, "x" * 50_000, "en", "b", 9),
        (12, "Ünï çödé 漢字 \x1f   thin\u2009space <|endoftext|> 😀 it's  two  spaces\r\nend ", "xx", "b", 10),
        (13, "same line here\nsame line here\n\nsame line here\n" * 30, "en", "a", 11),
    ]
    return rows + [(100 + i, prose(50 + i, 30 + 3 * i), "en" if i % 3 else "de", f"s{i % 4}", i) for i in range(40)]


def awkward(spark, parts: int = 3):
    df = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
