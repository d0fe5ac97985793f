"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The pre-tokens of all documents are counted; the ``LEXICON`` most frequent ones are encoded
once and compiled into a minimal acyclic automaton (equal suffixes share states) whose arcs
carry numbers that add up to the word's place, which points to its ids. The file lies in the shared folder, reaches
the executors through ``addFile`` and is memory-mapped there. A pre-token outside the lexicon is
merged exactly, lowest rank first, leftmost first. Look-ups and merges are made for all new
pre-tokens of a batch at once: words walk the automaton side by side, and a round of merging
takes every word's lowest-ranked pair.

Texts are cut before single spaces between other characters, where no pre-token can cross,
and the ids of such chunks are kept in a memo per worker, bounded in bytes and held in Arrow arrays,
so the lexicon answers for chunks that a worker has not met lately.

Added tokens inside a text get their own id, as in the tokenizers library. NULL counts as
empty: no ids, empty text back. Texts of any length are coded whole. Rows that repeat id or
text are rows of their own. An empty table gives an empty result. Columns other than
``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.caching import Spellings, giving_back, stretches, strung
from rillflow.scratch import scratch_path, store

LEXICON = 20_000
#: Bytes of text that are coded together and counted together; bytes of chunks kept; steps of the histogram of counts for each doubling.
TOGETHER, COUNTED, KEPT, STEPS = 2_000_000, 3_000_000, 24_000_000, 8
_NEVER = np.int64(1 << 40)
#: Unicode white space, as the library's pattern engine understands it.
WS = "\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: The same cuts where all characters are ASCII.
ASCII_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_CLOSE_SPACES = re.compile(f"[{WS}] ")
_MARK = "\x01"
_CUT = re.compile(f"(?<=[^{WS}])(?= )")


def chunks_of(text: str) -> list[str]:
    """Parts of a text whose pre-tokens are those of the text."""
    if _CLOSE_SPACES.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[f" {x}" for x in rest]]


def pre_tokens(chunk: str) -> list[str]:
    """Letters alone, with or without a space before them, are one pre-token."""
    if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
        return [chunk]
    return (ASCII_TOKEN if chunk.isascii() else PRE_TOKEN).findall(chunk)


def even(texts: pa.Array, added: Iterable[str]) -> pa.Array:
    """Whether a text can be cut before every space: no added token, no space after white space."""
    odd = pc.or_(pc.match_substring_regex(texts, _CLOSE_SPACES.pattern), pc.match_substring(texts, _MARK))
    for token in added:
        odd = pc.or_(odd, pc.match_substring(texts, token))
    return pc.invert(odd)


def cut_at_spaces(texts: pa.Array) -> pa.ListArray:
    """Chunks of texts that are even."""
    return pc.split_pattern(pc.replace_substring(texts, " ", f"{_MARK} "), _MARK)


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        keys = np.array(list(self.pairs), np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.merged = (np.array([v[k] for v in self.pairs.values()], np.int64)[order] for k in (0, 1))
        self.byte_table = np.array(self.byte_ids, np.int64)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        size = max([*vocab.values(), *added.values()]) + 1
        self.contents = [b""] * size
        for token, i in vocab.items():
            self.contents[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.contents[i] = token.encode()

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers.

        A pair that holds a merged token has a higher rank than the merge that made it, so all
        places of a word's lowest-ranked pair can be merged in one round, from the left.
        """
        ids = self.byte_table[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            pair = np.append(ids[:-1] << 20 | ids[1:], -1)
            pair[starts[1:] - 1] = -1  # the last token of a word has no partner
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            rank = np.where(self.keys[at] == pair, self.ranks[at], _NEVER)
            lengths = np.diff(np.append(starts, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            live = best < _NEVER
            if not live.all():
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                ids, word, rank, best, at = ids[live], word[live], rank[live], best[live], at[live]
                if not len(ids):
                    break
            hit = rank == best
            if (hit[1:] & hit[:-1]).any():  # of overlapping places every other one, from the left
                place = np.arange(len(hit))
                begins = hit & ~np.append(False, hit[:-1])
                hit &= (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
            ids[hit] = self.merged[at[hit]]
            stay = ~np.append(False, hit[:-1])
            ids, word = ids[stay], word[stay]
        if not done_ids:
            return [b""] * len(words)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        flat = ids[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge(self, word: bytes) -> list[int]:
        return np.frombuffer(self.merge_all([word])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.contents.__getitem__, ids)).decode("utf-8", "replace")


def compile_lexicon(entries: dict[bytes, list[int]], path: str) -> None:
    """Writes the automaton of ``entries``.

    Words are added in order; once a branch can grow no more, each of its states is replaced
    by an equal one that exists already (same finality, same arcs).
    """
    states: dict[tuple, int] = {}
    table: list[tuple] = []  # (final, ((label, target), ...))

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in states:
            states[key] = len(table)
            table.append(key)
        return states[key]

    stack = [[False, []]]
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(stack) - 1 > depth:
            done = settle(stack.pop())
            stack[-1][1].append((labels.pop(), done))

    words = sorted(entries)
    for word in words:
        same = 0
        while same < min(len(labels), len(word)) and labels[same] == word[same]:
            same += 1
        close(same)
        for b in word[same:]:
            labels.append(b)
            stack.append([False, []])
        stack[-1][0] = True
    close(0)
    root = settle(stack[0])
    counts: list[int] = []
    for final, arcs in table:  # targets come before their sources
        counts.append(final + sum(counts[t] for _, t in arcs))
    first, label, target, output = [0], bytearray(), [], []
    for final, arcs in table:
        passed = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            output.append(passed)
            passed += counts[t]
        first.append(len(label))
    ids = [entries[w] for w in words]
    parts = [
        np.array(first, "<u4"),
        np.array(target, "<u4"),
        np.array(output, "<u4"),
        np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u4"),
        np.array(list(chain.from_iterable(ids)), "<u4"),
    ]
    finals = bytes(f for f, _ in table)
    with open(path, "wb") as f:
        f.write(struct.pack("<8I", root, *[len(p) for p in parts], len(label), len(finals)))
        for p in parts:
            f.write(p.tobytes())
        f.write(bytes(label) + finals)


class Lexicon:
    """Reads the automaton through a memory map."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8I", self.map)
        at, arrays = 32, []
        for n in sizes[:5]:
            arrays.append(np.frombuffer(self.map, "<u4", n, at))
            at += 4 * n
        self.first, self.target, self.output, self.start, ids = arrays
        labels = np.frombuffer(self.map, np.uint8, sizes[5], at)
        self.final = np.frombuffer(self.map, np.uint8, sizes[6], at + sizes[5])
        # arcs in order of (state, label); the labels of a state are sorted
        self.arcs = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first.astype(np.int64))) * 256 + labels
        self.ids = ids.tobytes()

    def find_all(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of every word that the automaton accepts, as little-endian 32-bit integers."""
        n = len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(lengths) - lengths
        state, place = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live, step = np.flatnonzero(lengths > 0), 0
        accepted = np.zeros(n, bool)
        while len(live):
            wanted = state[live] * 256 + data[begin[live] + step]
            arc = np.searchsorted(self.arcs, wanted)
            arc[arc == len(self.arcs)] = 0
            known = self.arcs[arc] == wanted if len(self.arcs) else np.zeros(len(live), bool)
            live, arc = live[known], arc[known]
            place[live] += self.output[arc]
            state[live] = self.target[arc]
            step += 1
            ended = lengths[live] == step
            accepted[live[ended]] = self.final[state[live[ended]]] > 0
            live = live[~ended]
        found = np.where(accepted, place, 0)
        first, last = self.start[found].tolist(), self.start[found + 1].tolist() if len(self.start) > 1 else [0] * n
        return [self.ids[4 * a : 4 * b] if ok else None for a, b, ok in zip(first, last, accepted.tolist(), strict=True)]

    def find(self, word: bytes) -> bytes | None:
        return self.find_all([word])[0]


class Encoder:
    def __init__(self, bpe: ByteBpe, lexicon: Lexicon | None) -> None:
        self.bpe, self.lexicon = bpe, lexicon
        self.memo = Spellings(self.encode_chunks, KEPT)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        added = self.bpe.added
        split = [[c] if c in added else pre_tokens(c) for c in chunks]
        # a pre-token alone is a chunk, so the memo serves both; of these chunks it holds none
        coded = dict.fromkeys(w for part in split for w in part)
        inner = list(coded.keys() - set(chunks))
        at = self.memo.find(pa.array(inner, pa.string()))
        for k in np.flatnonzero(at >= 0).tolist():
            start = self.memo.starts[at[k]]
            coded[inner[k]] = self.memo.flat[start : start + self.memo.sizes[at[k]]].tobytes()
        coded |= {t: struct.pack("<I", added[t]) for t in added if t in coded}
        words = [w for w, ids in coded.items() if ids is None]
        raw = [w.encode() for w in words]
        found = self.lexicon.find_all(raw) if self.lexicon else [None] * len(raw)
        coded.update(zip(words, found, strict=True))
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.bpe.merge_all([raw[k] for k in unseen]), strict=True):
            coded[words[k]] = ids
        met = [inner[k] for k in np.flatnonzero(at < 0).tolist()]
        self.memo.add(pa.array(met, pa.string()), [coded[w] for w in met])
        return [coded[part[0]] if len(part) == 1 else b"".join([coded[w] for w in part]) for part in split]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts. Of texts cut at every space only the different chunks are Python strings."""
        plain = even(texts, self.bpe.added)
        lists = cut_at_spaces(pc.if_else(plain, texts, ""))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist()
        parts: list[str] = []
        first, borders = len(lists.flatten()), []
        for k in odd:
            for part in self.bpe.split_added.split(texts[k].as_py()) if self.bpe.split_added else [texts[k].as_py()]:
                # an added token is a chunk of its own, and no other chunk has its spelling
                parts += [part] if part in self.bpe.added else chunks_of(part) if part else []
            borders.append(first + len(parts))
        chunks = pa.concat_arrays([lists.flatten().cast(pa.string()), pa.array(parts, pa.string())]).dictionary_encode()
        offsets = lists.offsets.to_numpy()
        out = strung(*self.memo(chunks.dictionary), chunks.indices.to_numpy(), np.append(offsets - offsets[0], borders).astype(np.int64))
        for k, ids in zip(odd, out[len(texts) :], strict=True):
            out[k] = ids
        return out[: len(texts)]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def _encoder(path: str, lexicon: str) -> Encoder:
    return Encoder(_bpe(path), Lexicon(SparkFiles.get(lexicon)))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in stretches(batches, COUNTED):
            texts = batch.column("text")
            plain = even(texts, bpe.added)
            counts = cut_at_spaces(texts.filter(plain)).flatten().value_counts()
            chunks, n = counts.field("values"), counts.field("counts")
            whole = pc.match_substring_regex(chunks, r"^ ?\pL+$")  # one pre-token each
            yield pa.RecordBatch.from_arrays([chunks.filter(whole), n.filter(whole)], names=["word", "n"])
            mixed, words = pc.invert(whole), Counter()
            for chunk, times in zip(chunks.filter(mixed).to_pylist(), n.filter(mixed).to_pylist(), strict=True):
                for word in pre_tokens(chunk):
                    words[word] += times
            for text in texts.filter(pc.invert(plain)).to_pylist():
                for part in bpe.split_added.split(text)[::2] if bpe.split_added else [text]:
                    for chunk in chunks_of(part):
                        words.update(pre_tokens(chunk))
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    return giving_back(run)


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """``word, n`` of the most frequent pre-tokens of all documents: all above a count that at most ``most`` reach."""
    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counted(path), "word string, n long")
    counts = store(counts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # one row for each step of the counts reaches the driver, some hundred at most
    step = F.floor(F.log2("n") * STEPS)
    held, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        held += row["words"]
        if held > most:
            break
        least = row["least"]
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON) -> str:
    """Compiles the lexicon, hands it to the executors and returns its name. At most ``most`` words reach the driver."""
    words = [r["word"] for r in frequent_words(docs, path, most).collect()]
    raw = [w.encode() for w in words]
    name = f"lexicon-{uuid.uuid4().hex}.dawg"
    spark = docs.sparkSession
    shared = f"{scratch_path(spark, 'lexicon')}/{name}"
    with tempfile.TemporaryDirectory(prefix="lexicon-") as folder:
        local = os.path.join(folder, name)
        compile_lexicon({w: np.frombuffer(i, "<u4").tolist() for w, i in zip(raw, _bpe(path).merge_all(raw), strict=True)}, local)
        target = spark._jvm.org.apache.hadoop.fs.Path(shared)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file:{local}"), target)
    spark.sparkContext.addFile(files.makeQualified(target).toString())
    return name


def _coded(path: str, lexicon: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, lexicon)
        contents = pa.array(encoder.bpe.contents, pa.large_binary())
        for batch in stretches(batches, TOGETHER):
            coded = encoder.encode_all(batch.column("text"))
            ends = np.cumsum([0, *map(len, coded)])
            flat = pa.array(np.concatenate(coded).astype(np.int32))
            spelled = contents.take(flat)
            places = np.frombuffer(spelled.buffers()[1], np.int64, len(flat) + 1)[ends].tolist()
            data = spelled.buffers()[2].to_pybytes() if places[-1] else b""
            decoded = [data[a:b].decode("utf-8", "replace") for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return giving_back(run)


def encode_and_decode(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """``doc_id, ids, decoded``, one row per input row."""
    lexicon = build_lexicon(docs, path, most)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string"
    return slim.mapInArrow(_coded(path, lexicon), schema)
