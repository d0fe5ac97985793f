"""Bounded memos for per-task work on words, batches of texts in stretches of bounded size, memory given back after them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hands freed memory back to the system, where allocators would keep it for the process."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)  # functions travel to the workers by value, a loaded library cannot
    if hasattr(library, "malloc_trim"):  # GNU only
        library.malloc_trim(0)


def giving_back(task: Task) -> Task:
    """Spark keeps a worker for later tasks; it then holds what is in use, not what the largest task took."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


class TwoGenerations:
    """Keeps what was used lately: at ``limit`` new entries the older half is dropped."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], limit: int = 300_000) -> None:
        self.make, self.limit = make, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        young = self.young
        missing = set(keys).difference(young)
        if missing:
            old = self.old
            known = [k for k in missing if k in old] if old else []
            for k in known:
                young[k] = old[k]
            fresh = list(missing.difference(known) if known else missing)
            if fresh:
                young.update(zip(fresh, self.make(fresh), strict=True))
        out = list(map(young.__getitem__, keys))
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


class Spellings:
    """Keeps the 32-bit values of texts used lately as Arrow and numpy arrays, some thirty bytes for a short text.

    ``make`` answers for texts not held. Beyond ``limit`` bytes those used longest ago are dropped
    until at most half is left, so neither many texts nor long ones can fill a worker.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int) -> None:
        self.make, self.limit, self.clock = make, limit, 0
        self._hold(pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def _hold(self, texts: pa.Array, flat: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> None:
        self.texts, self.flat, self.sizes, self.used = texts, flat, sizes, used
        self.starts = np.cumsum(sizes, dtype=np.int64) - sizes

    @property
    def held(self) -> int:
        """Bytes of all arrays."""
        return self.texts.nbytes + sum(x.nbytes for x in (self.flat, self.sizes, self.used, self.starts))

    def find(self, texts: pa.Array) -> np.ndarray:
        """Where every text is held, -1 for none."""
        at = np.array(pc.fill_null(pc.index_in(texts, value_set=self.texts), -1))
        self.used[at[at >= 0]] = self.clock
        return at

    def add(self, texts: pa.Array, values: list[bytes]) -> None:
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        self._hold(
            pa.concat_arrays([self.texts, texts]),
            np.concatenate([self.flat, np.frombuffer(b"".join(values), "<u4")]),
            np.concatenate([self.sizes, sizes]),
            np.concatenate([self.used, np.full(len(values), self.clock, np.int32)]),
        )

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, and where those of every text start and how many they are. No text may repeat."""
        self.clock += 1
        at = self.find(texts)
        new = at < 0
        if new.any():
            fresh = texts.filter(pa.array(new))
            made = self.make(fresh.to_pylist())
            at[new] = len(self.texts) + np.arange(len(fresh))  # make may have added parts of texts
            self.add(fresh, made)
        out = self.flat, self.starts[at], self.sizes[at].astype(np.int64)
        if self.held > self.limit:
            self._drop()
        return out

    def _drop(self) -> None:
        latest = np.argsort(-self.used, kind="stable")
        each = 20 + pc.binary_length(self.texts).to_numpy().astype(np.int64) + 4 * self.sizes  # 20: offsets, size, start, use
        stay = np.sort(latest[np.cumsum(each[latest]) <= self.limit // 2])
        sizes = self.sizes[stay]
        self._hold(self.texts.take(pa.array(stay)), self.flat[ranges(self.starts[stay], sizes)], sizes, self.used[stay])


def stretches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of about ``size`` bytes of ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        before = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        borders = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            yield batch.slice(lo, hi - lo)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def joined(parts: list[bytes], codes: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """32-bit values of ``parts[codes]`` one after the other, cut where ``borders`` places of ``codes`` have passed."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return strung(np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes, sizes, codes, borders)


def strung(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """The same of ranges of ``flat``."""
    n = sizes[codes]
    stream = flat[ranges(starts[codes], n)]
    cuts = np.append(0, np.cumsum(n))[borders - borders[0]].tolist()
    return [stream[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
