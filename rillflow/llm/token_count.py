"""Token counts without tokens: Viterbi over a unigram vocabulary that carries score and count.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character, longest
first. The best score of a position and the number of pieces on its path are kept, nothing
else. Ties go to the earliest start, as in the tokenizers library, which replaces a path only
by a strictly better one. A character that is no piece of its own costs the lowest score less
ten and counts as its UTF-8 bytes (byte fallback), or joins its neighbours as one unknown.

Scores are multiples of 1/1024, so their sums are exact and ties are the same wherever a
word stands. If no piece crosses the border before a word mark, words are counted apart and
remembered per worker; otherwise whole texts are.

The public vocabularies at hand hold merge ranks, not probabilities; ``unigram_vocabulary``
gives the piece of rank r the Zipf score -ln(r + 2). Any list of (piece, score) will do.

NULL counts as empty: no tokens, score 0. An empty table gives an empty result. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 300_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a public model in the order of their ids; control and byte pieces are the least likely."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    score = lambda rank: -round(math.log(rank + 2) * 1024) / 1024
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return [(model.id_to_piece(i), score(n + i) if odd(i) else score(i)) for i in range(n)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary)
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count, dark = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(text)
        pending = next(matches, None)
        for end in range(n):
            top, pieces, alone = None, 0, False
            while pending is not None and pending[0] == end:
                length, score = pending[1]
                start = end + 1 - length
                score += best[start]
                if top is None or score > top:
                    top, pieces = score, count[start] + 1
                alone |= length == 1
                pending = next(matches, None)
            lost = False
            if not alone:
                score = best[end] + self.unknown
                if top is None or score > top:
                    top, lost = score, True
                    if self.byte_fallback:
                        pieces = count[end] + len(text[end].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[end] + (not dark[end])
            best[end + 1], count[end + 1], dark[end + 1] = top, pieces, lost
        return count[n], best[n]

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        text = text if text.startswith(MARK) else MARK + text
        if not self.by_word:
            return self.viterbi(text)
        words, known = re.findall(f"{MARK}+[^{MARK}]*", text), self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.viterbi(w)
        found = [known[w] for w in words]
        return sum(c for c, _ in found), sum(s for _, s in found)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(unigram_vocabulary(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, best_score``, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            found = [counter(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "n_tokens", "best_score"],
            )

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, best_score double")
