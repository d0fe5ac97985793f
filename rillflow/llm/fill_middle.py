"""Fill-in-the-middle transformation with content-defined chunk memoization.

1. *Chunks.* A rolling hash over the last ``WINDOW`` bytes cuts texts where the content says so, hence
   passages shared by documents become the same chunks wherever they stand.
2. *Memo.* A chunk's boundary summary (words that end inside it and where, white space at its two ends,
   its code points) is kept under its complete content, so a look-up is verified byte by byte. The memo
   holds a bounded number of bounded chunks.
3. *Combination.* A word ends inside a chunk, or at its end if the next chunk starts with white space or
   the text ends. Prefix sums of the chunks' counts give the number of units of a text and lead to the
   chunk that holds a cut; only there positions are read.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own.
Cuts, order and form are drawn by SHA-256 of ``seed:doc_id``, so reruns agree.

NULL text counts as empty; an empty text, one that holds a marker, and one not drawn stay plain. A NULL
``doc_id`` draws like an empty one. Rows that repeat an id draw alike, each on its own text. Texts of any
length are cut in blocks of ``BLOCK`` bytes and never shortened. All columns of the input travel in one
struct, so names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.caching import TwoGenerations

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes the rolling hash sees, mean and largest length of a chunk, bytes hashed at once, chunks kept.
WINDOW, MEAN, LARGEST, BLOCK, KEPT = 32, 512, 2048, 4 << 20, 30_000

_GEAR = (((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_SHIFT = np.uint32(32 - MEAN.bit_length() + 1)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each byte (fewer at the start), by doubling."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted chunk borders of texts that lie end to end; ``offsets`` are the borders of the texts."""
    cuts = []
    for at in range(0, len(data), BLOCK):
        left = max(0, at - WINDOW + 1)
        h = rolling(data[left : at + BLOCK])[at - left :]
        cuts.append(np.flatnonzero((h >> _SHIFT) == 0) + at + 1)
    found = np.concatenate(cuts) if cuts else np.empty(0, np.int64)
    # the window of a cut lies inside its text
    start = offsets[np.searchsorted(offsets, found - 1, "right") - 1]
    cuts = np.unique(np.concatenate([found[found - start >= WINDOW], offsets]))
    gaps = np.diff(cuts)
    more = (gaps - 1) // LARGEST
    if not more.any():
        return cuts
    where = np.repeat(np.arange(len(gaps)), more)
    nth = np.arange(len(where)) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.unique(np.concatenate([cuts, cuts[where] + nth * LARGEST]))


def summaries(chunks: list[bytes]) -> list[tuple[int, bool, bool, int, np.ndarray]]:
    """Words that end before the last byte, white space first, white space last, code points, ends of those words."""
    data = np.frombuffer(b"".join(chunks), np.uint8)
    border = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
    space = _IS_SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    ends = ends[~np.isin(ends, border)]
    lies = np.searchsorted(ends, border)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [
        (int(lies[k + 1] - lies[k]), bool(space[border[k]]), bool(space[border[k + 1] - 1]), int(chars[border[k + 1]] - chars[border[k]]),
         (ends[lies[k] : lies[k + 1]] - border[k]).astype(np.int16))
        for k in range(len(chunks))
    ]


class Cutter:
    """Numbers of units and cut positions of texts."""

    def __init__(self) -> None:
        self.memo = TwoGenerations(summaries, KEPT)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Units of every text, and for every array of draws the code points before unit ``draw % (n + 1)``, in order of size."""
        cuts = boundaries(data, offsets)
        view, borders = memoryview(data), cuts.tolist()
        known = self.memo([view[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]) if len(cuts) > 1 else []
        inner = np.fromiter((x[0] for x in known), np.int64, len(known))
        first = np.fromiter((x[1] for x in known), bool, len(known))
        last = np.fromiter((x[2] for x in known), bool, len(known))
        chars = np.concatenate([[0], np.cumsum(np.fromiter((x[3] for x in known), np.int64, len(known)))])
        chunk = np.searchsorted(cuts, offsets)  # first chunk of each text, and one behind
        opens = np.zeros(len(known) + 1, bool)
        opens[chunk] = True
        follows = np.append(first[1:], True) | opens[1:]
        ends = np.concatenate([[0], np.cumsum(inner + (~last & follows))])
        lo, hi = chunk[:-1], chunk[1:]
        filled = hi > lo
        trailing = np.zeros(len(lo), np.int64)
        trailing[filled] = last[hi[filled] - 1]
        n = ends[hi] - ends[lo] + trailing
        places = []
        for units in np.sort(np.stack([d % (n + 1).astype(np.uint64) for d in draws]).astype(np.int64), axis=0) if draws else []:
            place = np.where(units == n, chars[hi] - chars[lo], 0)
            for k in np.flatnonzero((units > 0) & (units < n)).tolist():
                wanted = ends[lo[k]] + units[k]
                j = int(np.searchsorted(ends, wanted)) - 1
                nth = int(wanted - ends[j])
                if nth > inner[j]:
                    place[k] = chars[j + 1] - chars[lo[k]]
                else:
                    upto = borders[j] + int(known[j][4][nth - 1])
                    place[k] = chars[j] - chars[lo[k]] + np.count_nonzero((data[borders[j] : upto] & 0xC0) != 0x80)
            places.append(place)
        return n, places


def _located(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    cutter = Cutter()
    for text, h1, h2 in batches:
        text = text.cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        buffer = text.buffers()[2]
        data = np.frombuffer(buffer if buffer is not None else b"", np.uint8)[offsets[0] : offsets[-1]] if len(text) else np.empty(0, np.uint8)
        draws = [h.to_numpy(zero_copy_only=False).astype(np.uint64) for h in (h1, h2)]
        n, (a, b) = cutter(data, offsets - offsets[0], draws)
        yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, a, b)], names=["n", "a", "b"])


def fill_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``record`` (all columns), ``n``, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars``, ``output``."""
    located = F.arrow_udf(_located, "n long, a long, b long")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    one = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), F.coalesce("text", F.lit("")).alias("t"), named.alias("h"))
    draw = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long")
    at = one.select("record", "t", located("t", draw(0), draw(1)).alias("at"), draw(2).alias("h3"), draw(3).alias("h4"))
    marked = F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE)
    form = F.when((F.col("t") == "") | marked | (F.col("h3") % 100 >= fim_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    at = at.select("record", "t", "at.n", form.alias("form"), F.col("at.a").cast("int").alias("a"), F.col("at.b").cast("int").alias("b"))
    prefix, middle = F.substring("t", F.lit(1), F.col("a")), F.substring("t", F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substring("t", F.col("b") + 1, F.char_length("t"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return at.select(
        "record", "n", "form",
        F.when(cut, F.col("a").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation. A cut text holds every marker once, as texts with a marker stay plain."""
    before = lambda mark, text: F.substring_index(text, mark, 1)
    after = lambda mark, text: F.substring_index(text, mark, -1)
    middle = after(MIDDLE, output)
    rest = before(MIDDLE, output)
    psm = F.concat(after(PREFIX, before(SUFFIX, rest)), middle, after(SUFFIX, rest))
    spm = F.concat(after(PREFIX, rest), middle, after(SUFFIX, before(PREFIX, rest)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
