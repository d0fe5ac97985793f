"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt into ranges of ``doc_id`` (equal ids by content), encoded and written in
order, one file per range. A block holds ``BLOCK`` ids of the file's stream less their
minimum, packed at the width that ``PERCENTILE`` of them fit; the high bits of the others
follow as lists of places and values. The file ends with the starts of its blocks, the ids
and lengths of its documents and the place of this index.

A task writes under a name of its own and reports it in its result; the written manifest
names the files that count, so a repeated task leaves at most a file nobody reads. Files lie
under ``spark.checkpoint.dir`` and are opened through Arrow's file systems.

Texts are cut at spaces and line ends, which the tokenizer drops, and different chunks are
encoded by the tokenizers library, those new to a worker together (bounded memo).

NULL counts as empty: the end id alone. NULL ids come first. Texts of any length are encoded
whole. Rows that repeat an id follow each other, each with its own ids. An empty table gives an
empty result. Columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.caching import TwoGenerations, joined, stretches
from rillflow.scratch import scratch_path, store

MAGIC = b"PFOR0001"
BLOCK = 1024
PERCENTILE = 95
END_ID = 1
#: Bytes of text whose chunks are looked up together (one row at least), runs that go to the library in one line, chunks kept.
TOGETHER, LINE, KEPT = 8_000_000, 20_000, 500_000
_RUN = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ASCII_RUN = re.compile(r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Each row as ``u4 minimum, u2 count, u1 width, u1 high width, u2 exceptions | packed | u2 places | u4 high parts``."""
    n = ids.shape[1]
    low = ids.min(axis=1)
    rest = (ids - low[:, None]).astype(np.uint32)
    lengths = np.frexp(rest.astype(np.float64))[1]  # bits of each value, 0 for 0
    widths = np.partition(lengths, k := (n * PERCENTILE - 1) // 100, axis=1)[:, k]
    out = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        shifts = np.arange(width, dtype=np.uint32)
        bits = ((rest[rows][:, :, None] >> shifts) & 1).astype(np.uint8).reshape(len(rows), n * width)
        for row, packed in zip(rows.tolist(), np.packbits(bits, axis=1, bitorder="little"), strict=True):
            odd = np.flatnonzero(lengths[row] > width)
            high = (rest[row, odd] >> np.uint32(width)).astype("<u4").tobytes()
            head = struct.pack("<IHBBH", low[row], n, width, 0, len(odd))
            out[row] = head + packed.tobytes() + odd.astype("<u2").tobytes() + high
    return out


def pack_block(ids: np.ndarray) -> bytes:
    return pack_blocks(ids[None, :])[0]


def unpack_block(data: bytes) -> np.ndarray:
    low, n, width, _, n_odd = struct.unpack_from("<IHBBH", data)
    at, size = 10, (n * width + 7) // 8
    rest = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        rest = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    at += size
    places = np.frombuffer(data, "<u2", n_odd, at)
    high = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    rest[places] |= high.astype(np.uint32) << np.uint32(width)
    return rest + np.uint32(low)


def file_system(path: str):
    """(Arrow file system, path in it)."""
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


class Writer:
    def __init__(self, out) -> None:
        self.out, self.at = out, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= 64 * BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        stream = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(stream) if last else len(stream) // BLOCK * BLOCK
        full = whole // BLOCK * BLOCK
        blocks = [b for lo in range(0, full, 64 * BLOCK) for b in pack_blocks(stream[lo : min(lo + 64 * BLOCK, full)].reshape(-1, BLOCK))]
        if full < whole:
            blocks.append(pack_block(stream[full:whole]))
        for block in blocks:
            self.starts.append(self.at)
            self._write(block)
        self.waiting, self.n_waiting = [stream[whole:]], len(stream) - whole

    def close(self) -> None:
        self._blocks(True)
        index = self.at
        known = np.array([d is not None for d in self.docs], np.uint8)
        self._write(np.array(self.starts, "<u8").tobytes())
        self._write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._write(known.tobytes())
        self._write(np.array(self.lengths, "<u8").tobytes())
        self._write(struct.pack("<QQQ", index, len(self.starts), len(self.docs)) + MAGIC)


def read_documents(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) in order; holds a few blocks and one document."""
    source.seek(size - 32)
    tail = source.read(32)
    index, n_blocks, n_docs = struct.unpack_from("<QQQ", tail)
    if tail[24:] != MAGIC:
        raise ValueError("not a token file")
    source.seek(index)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8").tolist() + [index]
    docs = np.frombuffer(source.read(8 * n_docs), "<i8").tolist()
    known = np.frombuffer(source.read(n_docs), np.uint8).tolist()
    lengths = np.frombuffer(source.read(8 * n_docs), "<u8").tolist()
    have, at, block, start = np.empty(0, np.uint32), 0, 0, 0
    for doc_id, ok, n in zip(docs, known, lengths, strict=True):
        parts, missing = [], n
        while True:
            take = have[at : at + missing]
            parts.append(take)
            at += len(take)
            missing -= len(take)
            if not missing:
                break
            upto = min(n_blocks, block + 64)
            source.seek(starts[block])
            data = source.read(starts[upto] - starts[block])
            base = starts[block]
            have = np.concatenate([unpack_block(data[starts[b] - base : starts[b + 1] - base]) for b in range(block, upto)])
            at, block = 0, upto
        yield (doc_id if ok else None), start, np.concatenate(parts)
        start += n


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, chunk by chunk.

    A normalised chunk without apostrophe or ``<`` falls into runs of letters, single digits and runs of
    signs, which the tokenizer's pattern separates too. All runs that are new go to the library in one
    line, and a token that ends a word ends its run. Other chunks are encoded one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = TwoGenerations(self._make, KEPT)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run_ids(self, runs: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(runs), LINE):
            part = runs[lo : lo + LINE]
            ids = np.array(self._ids([" ".join(part)])[0], "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):  # not a tokenizer with word ends
                out += [np.array(i, "<u4").tobytes() for i in self._ids(part)]
                continue
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    @staticmethod
    def _split(chunk: str) -> list[str] | None:
        """The runs of a chunk, None if it has to be encoded as it stands."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            return None if "'" in chunk or "<" in chunk else _ASCII_RUN.findall(chunk)
        if "'" in chunk or "<" in chunk or len(chunk.lower()) != len(chunk) or not unicodedata.is_normalized("NFC", chunk):
            return None
        return _RUN.findall(chunk)

    def _make(self, chunks: list[str]) -> list[bytes]:
        split = list(map(self._split, chunks))
        odd = iter(self._ids([c for c, runs in zip(chunks, split, strict=True) if runs is None]))
        young, old = self.memo.young, self.memo.old  # a run alone is a chunk, so the memo serves both
        needed = {r for runs in split if runs is not None for r in runs}
        coded = {r: ids for r in needed if (ids := young.get(r) or old.get(r))}
        fresh = list(needed.difference(coded))
        coded.update(zip(fresh, self._run_ids(fresh), strict=True))
        young.update(coded)
        return [
            np.array(next(odd), "<u4").tobytes() if runs is None else coded[runs[0]] if len(runs) == 1 else b"".join([coded[r] for r in runs])
            for runs in split
        ]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text. Only the different chunks, ASCII ones in small letters, are Python strings."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        different = coded.dictionary
        ids = self.memo(pc.if_else(pc.string_is_ascii(different), pc.ascii_lower(different), different).to_pylist())
        return joined(ids, coded.indices.to_numpy(), split.offsets.to_numpy())

    def __call__(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files below ``path`` and returns the manifest ``part, file, n_docs, n_ids``."""
    path = path or scratch_path(docs.sparkSession, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _library(tokenizer)
        part, name, writer, out = TaskContext.get().partitionId(), "", None, None
        for batch in stretches(batches, TOGETHER):
            if writer is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
                files, folder = file_system(path)
                files.create_dir(folder, recursive=True)
                out = files.open_output_stream(f"{folder}/{name}")
                writer = Writer(out)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode_all(batch.column("text")), strict=True):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int64()), "file": [f"{path}/{name}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())}
            )

    content = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(content).alias("h"), content.alias("text"))
    ordered = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return store(ordered.select("doc_id", "text").mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of all files; ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts all ids before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                files, name = file_system(path)
                with files.open_input_file(name) as source:
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, start, ids in read_documents(source, source.size()):
                        rows.append((doc_id, base + start, ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held > 500_000:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    order = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    files = max(1, manifest.count())
    return based.repartition(files).mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        names=["doc_id", "start", "ids"],
    )
