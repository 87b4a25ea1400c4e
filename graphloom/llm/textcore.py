"""Vectorised text primitives over Arrow string columns.

All functions work on the UTF-8 bytes of whole texts, a few megabytes at a time, and never loop over
characters in Python.  Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, which is the same
as the code-point definition because those six separators are ASCII.

Hashes are 64-bit: a polynomial over a fixed random byte table modulo 2**64, finished by a mixer.  Two
different words collide with probability about 2**-64 per pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U64) | U64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)
_powers: list[np.ndarray] = []

#: Rows and bytes given to Python at once; with the chunking below they bound a worker's memory.
ARROW_ROWS = 1024
ARROW_BYTES = "16m"
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 16)
        tables = []
        for base in (_BASE, _BASE_INV):
            out = np.ones(n, U64)
            done = 1
            while done < n:
                step = min(done, n - done)
                out[done : done + step] = out[:step] * U64(pow(base, done, 2**64))
                done += step
            tables.append(out)
        _powers[:] = tables
    return _powers[0], _powers[1]


@dataclass
class Chunk:
    """Consecutive texts of one batch: ``data`` holds their bytes, text ``i`` is ``data[offsets[i]:offsets[i+1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def prefix_hash(self, fold: bool = False) -> np.ndarray:
        """``out[i]`` covers the bytes before ``i``; differences give the hash of any span."""
        power, _ = _power_tables(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum((_FOLDED if fold else _TABLE)[self.data] * power[: len(self.data)], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


#: glibc's call that gives freed memory back to the system.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Give freed memory back to the system, with tables that only a long text needed: workers live on between stages."""
    if _powers and len(_powers[0]) > CHUNK_BYTES + 16:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts in chunks of about ``limit`` bytes; a longer text is a chunk of its own; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield Chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    give_back()


@dataclass
class Words:
    """The words of a chunk in order: byte spans, text index, and per text the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(chunk: Chunk, separators: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that ``separators`` (a flag for each byte) does not mark."""
    n = len(chunk.data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(separators[chunk.data], out=solid[1:-1])
    inner = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    if len(inner):
        first[inner] = solid[1:-1][inner]
        last[inner - 1] = solid[1:-1][inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, chunk.offsets)
    row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    return Words(starts, ends, row, bounds)


def word_hashes(chunk: Chunk, found: Words, fold: bool = False, prefix: np.ndarray | None = None) -> np.ndarray:
    if prefix is None:
        prefix = chunk.prefix_hash(fold)
    return span_hash(prefix, found.starts, found.ends)


def windows(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie within one text, and the index of each window's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for j in range(k):
        total += hashes[j : j + n] * (_MULT[j % 5] + U64(2 * (j // 5)))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(total[at]), at


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its index and the sorted distinct hashes of its k-word shingles, A-Z lower-cased.

    A text of fewer than ``k`` words has its whole word sequence as one shingle; one without words none.
    """
    for chunk in chunks(texts):
        found = words(chunk)
        hashes = word_hashes(chunk, found, fold=True)
        shingles, at = windows(hashes, found.row, k)
        edges = np.searchsorted(at, found.bounds)
        for i, n in enumerate(found.counts):
            if n >= k:
                yield chunk.first + i, np.unique(shingles[edges[i] : edges[i + 1]])
            elif n:
                own = hashes[found.bounds[i] : found.bounds[i + 1]]
                yield chunk.first + i, mix(np.sum(own * _MULT[:n], keepdims=True) + U64(n))
            else:
                yield chunk.first + i, np.zeros(0, U64)


def table_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
