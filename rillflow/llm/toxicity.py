"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained: one on excerpts of ordinary text, one on the words that toxic
text has and ordinary text lacks. A window is one word between two fixed stretches of
ordinary text. It is compressed with the ordinary dictionary and with the toxic one laid over
it; the second length falls short of the first where the toxic dictionary explains the word.
How many and which share of a document's words gain how many bytes goes into a logistic
curve, calibrated on the labelled rows, whose output is the score.

The fit uses a bounded sample: of the labelled rows that are not held out and whose text has
at most ``TRAIN_BYTES`` bytes, ``TOXIC_ROWS`` toxic and ``ORDINARY_ROWS`` other ones, those
with the smallest hash of their id. An id with several labels is toxic if one says so, and an id
with several texts is learned from its smallest, so at most twice as many rows as named reach the
driver however often an id is repeated. Held out are ids whose decimal text has a CRC-32 that
leaves 1 when divided by 3. Scoring reads every whole text; nothing but the text enters it.

NULL or empty text has the score of a document without words; very long texts are read whole, in
the task that holds them. Repeated rows are scored one by one and alike. Other columns of any name are left out. Without toxic or without
ordinary rows to learn from, all scores are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOXIC_ROWS = 1500
ORDINARY_ROWS = 4500
TRAIN_BYTES = 20_000
ORDINARY_DICTIONARY = 64 << 10
TOXIC_DICTIONARY = 32 << 10
LEVEL = 12
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: A word is contrastive if its share of toxic documents is so many times its share of others.
CONTRAST, LEAST_DOCS = 20, 3
STEMS = (4, 5, 6)
GAINS = (2, 3, 4, 5, 6)
WINDOWS_KEPT = 400_000
#: ASCII letters lower-cased, other ASCII but letters and digits to spaces, the rest as it is.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; with too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _contrastive(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    def documents_with(texts: list[list[bytes]]) -> Counter[bytes]:
        found: Counter[bytes] = Counter()
        for words in texts:
            different = set(words)
            found.update(different | {w[:k] for w in different for k in STEMS if len(w) > k})
        return found

    with_toxic, with_ordinary = documents_with(toxic), documents_with(ordinary)
    least = CONTRAST * len(toxic) / max(1, len(ordinary))
    return {w for w, n in with_toxic.items() if n >= min(LEAST_DOCS, len(toxic)) and n > least * (with_ordinary[w] + 0.5)}


class Model:
    """Dictionaries and curve; small, and sent to the tasks by value."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.weights, self.centre, self.scale = weights, centre, scale


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.laid = self._compressor(ordinary), self._compressor(ordinary + toxic)
        self.left, self.right = ordinary[-72:-40] + b" ", b" " + ordinary[-40:-8]
        self.gains: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _gain(self, word: bytes) -> int:
        window = self.left + word + self.right
        return len(self.plain.compress(window)) - len(self.laid.compress(window))

    def features(self, words: list[bytes]) -> list[float]:
        gains = self.gains
        if len(gains) > WINDOWS_KEPT:
            gains.clear()
        for w in set(words).difference(gains):
            gains[w] = self._gain(w)
        n = max(1, len(words))
        got = np.bincount(np.clip(np.fromiter(map(gains.__getitem__, words), np.int64, len(words)), 0, 15), minlength=16)
        reach = got[::-1].cumsum()[::-1]
        top = int(np.flatnonzero(got)[-1]) if len(words) else 0
        return [math.sqrt(reach[k] / n) for k in GAINS] + [math.log1p(reach[k]) for k in GAINS] + [float(top), math.log(n)]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(w)), a.T @ (y - p) - w)
    return w, centre, scale


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    if not toxic or not ordinary:
        return None
    toxic_words, ordinary_words = [words_of(t) for t in toxic], [words_of(t) for t in ordinary]
    marks = _contrastive(toxic_words, ordinary_words)
    marked = lambda w: w in marks or any(w[:k] in marks for k in STEMS if len(w) > k)
    excerpts = [b" " + b" ".join(found) + b" " for words in toxic_words if (found := [w for w in words if marked(w)])]
    if not excerpts:
        return None
    # four looks at each excerpt: the trainer wants many times the size of the dictionary
    over = _dictionary(excerpts * 4, TOXIC_DICTIONARY)
    plain = [b" ".join(words[lo : lo + 50]) for words in ordinary_words for lo in range(0, min(len(words), 200), 50)]
    base = _dictionary([p for p in plain if p], ORDINARY_DICTIONARY)
    scorer = Scorer(base, over)
    x = np.array([scorer.features(w) for w in toxic_words + ordinary_words])
    return Model(base, over, *_curve(x, np.array([1.0] * len(toxic) + [0.0] * len(ordinary))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Texts of at most ``TOXIC_ROWS`` toxic and ``ORDINARY_ROWS`` ordinary rows that are not held out."""
    learn = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    limits = {1: TOXIC_ROWS, 0: ORDINARY_ROWS}
    # the ids are drawn with some to spare, before any text moves
    chosen = [learn.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n) for k, n in limits.items()]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    out = []
    for k, n in limits.items():
        mine = [r for r in rows if r["toxic"] == k]
        step = max(1, len(mine) / n)
        out.append([mine[int(i * step)]["text"] for i in range(min(n, len(mine)))])
    return out[0], out[1]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row."""
    model = train(*training_rows(docs, labels))
    slim = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.ordinary, model.toxic)
        for batch in batches:
            x = np.array([scorer.features(words_of(t.as_py())) for t in batch.column("text")]).reshape(batch.num_rows, -1)
            z = model.weights[0] + (x - model.centre) / model.scale @ model.weights[1:] if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    scored = slim.select("doc_id", F.lit(0.0).alias("score")) if model is None else slim.mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
