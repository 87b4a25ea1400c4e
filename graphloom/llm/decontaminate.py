"""Benchmark decontamination: CGK embedding of the segments of items, hashed look-up, exact edit verification.

A document leaks an item when some window of it is within ``tau`` times the item's words of edit distance from the
item, words compared A-Z lower-cased.  No step but the last drops a leak (64-bit hashes taken as the words):

1. *Lossless narrowing.*  A window that close shares many of the item's 3-word sequences (each edit spoils at most
   three), so only stretches of a text dense in 3-word sequences of the benchmark are looked at further.
2. *CGK embedding.*  ``e`` edits leave at least ``(n - e) / (e + 1)`` words of an item of ``n`` in one piece, wherever
   they fall.  So every segment of that many words, of items and of texts alike, is embedded: walked by word for three
   steps a word, a random bit per (step, word) says whether the walk moves on, and what is read at each step is the
   embedding.
3. *Look-up.*  A segment of the text and one of an item with equal embeddings align the two.  The piece that the edits
   left is such a pair.  All steps are hashed: at ``TAU`` segments have three or four words, and a sample of their steps
   would tell less apart without finding more.
4. *Verification.*  Where the text around an alignment holds enough of the item's own 3-word sequences, the exact edit
   distance of the item to the best substring there.

The benchmark is the small side: it is packed on the driver and broadcast, ``MAX_ITEMS_BYTES`` at a time; a larger
benchmark takes several passes over the documents.

Edge cases: null or empty texts leak nothing; null, empty and blank items are never leaked; items shorter than
``SHORT_WORDS`` words, to which ``TAU`` allows no edit, are matched exactly, as word sequences; very long texts are searched
whole; equal items are all reported; repeated documents are reported as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.cluster import prepare

#: Edits allowed, as a share of the item's words.
TAU = 0.2
SHORT_WORDS = 5
#: Pairs of segments that are expanded at once.
PAIRS = 1 << 18
MAX_ITEMS_BYTES = 16 << 20
_U = np.uint64


def _text_words(text: str) -> np.ndarray:
    for chunk in tc.chunks(pa.array([text])):
        return tc.word_hashes(chunk, tc.words(chunk), fold=True)
    return np.zeros(0, _U)


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of ``item`` to any substring of ``text`` (words as hashes)."""
    row = np.zeros(len(text) + 1, np.int64)
    at = np.arange(len(text) + 1)
    for w in item:
        best = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        nxt = np.concatenate([[row[0] + 1], best])
        row = np.minimum.accumulate(nxt - at) + at
    return int(row.min())


def _walk(words: np.ndarray, starts: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    """CGK codes of the ``length`` words from each start: a hash of what the walk reads at its steps, a pad past the segment."""
    moved = np.zeros(len(starts), np.int64)
    code = np.full(len(starts), seed)
    salt = code * _U(0x10001)
    moved = np.zeros(len(starts), np.int64)
    for step in range(3 * length):
        w = np.where(moved < length, words[starts + np.minimum(moved, length - 1)], _U(0))
        code = tc.mix(code * _U(0x9E3779B97F4A7C15) + w + _U(step))
        moved += (tc.mix(w + salt + _U(1 + step * 0x1000193)) >> _U(63)).astype(np.int64)
    return code


def _runs(at: np.ndarray, gap: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of sorted places that are at most ``gap`` apart."""
    cut = np.flatnonzero(np.diff(at) > gap) + 1
    for part in np.split(at, cut):
        yield int(part[0]), int(part[-1])


class Benchmark:
    """Items packed for search: word hashes, 3-word sequences, and the CGK codes of the segments of each class of lengths."""

    def __init__(self, items: list[tuple[int, str]], tau: float = TAU):
        self.tau = tau
        self.items = [(i, w) for i, t in items if t and len(w := _text_words(t))]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.by_length: dict[int, list[int]] = {}
        self.own: dict[int, np.ndarray] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < SHORT_WORDS:
                self.short.setdefault(len(w), {}).setdefault(self._whole(w), []).append(k)
            else:
                self.by_length.setdefault(len(w), []).append(k)
                self.own[k] = np.unique(tc.windows(w, np.zeros(len(w), np.int8), 3)[0])
        self.grams = np.unique(np.concatenate(list(self.own.values()))) if self.own else np.zeros(0, _U)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.grams >> _U(44)).astype(np.int64)] = True
        # Items of similar lengths share their stretches and the length of their segments.
        rng = np.random.default_rng(11)
        self.classes: list[dict] = []
        for n in sorted(self.by_length):
            if not self.classes or n > 1.25 * self.classes[-1]["lengths"][0]:
                self.classes.append({"lengths": [], "items": []})
            self.classes[-1]["items"] += self.by_length[n]
            self.classes[-1]["lengths"].append(n)
        for c in self.classes:
            c["need"] = min(map(self.shared, c["lengths"]))
            c["span"] = c["lengths"][-1] + self.edits(c["lengths"][-1])
            c["segment"] = length = max(1, min(-(-(n - self.edits(n)) // (self.edits(n) + 1)) for n in c["lengths"]))
            c["seed"] = rng.integers(1, 2**63, dtype=_U)
            starts = [np.arange(len(self.items[k][1]) - length + 1) for k in c["items"]]
            codes = np.concatenate([_walk(self.items[k][1], at, length, c["seed"]) for k, at in zip(c["items"], starts, strict=True)])
            order = np.argsort(codes, kind="stable")
            c["codes"] = codes[order]
            c["item"] = np.repeat(np.array(c["items"]), [len(at) for at in starts])[order]
            c["at"] = np.concatenate(starts)[order]
        #: Some items may be leaked by a text without any of their 3-word sequences.
        self.unnarrowed = any(c["need"] <= 0 for c in self.classes)

    @staticmethod
    def _whole(w: np.ndarray) -> int:
        return int(np.bitwise_xor.reduce(tc.mix(w + np.arange(len(w)).astype(_U))) + _U(len(w)))

    def edits(self, n: int) -> int:
        return int(self.tau * n)

    def shared(self, n: int) -> int:
        """3-word sequences that an item of n words keeps at least in a text that leaks it."""
        return n - 2 - 3 * self.edits(n)

    def found_in(self, words: np.ndarray, grams: np.ndarray, hits: np.ndarray) -> dict[int, int]:
        """Items of SHORT_WORDS words or more that the text leaks, with their distances; hits marks the benchmark's among its 3-word sequences."""
        out: dict[int, int] = {}
        total = np.concatenate([[0], np.cumsum(hits)])
        for c in self.classes:
            if total[-1] < c["need"] or len(words) < c["segment"]:
                continue
            starts = np.arange(len(words))
            dense = starts[total[np.minimum(starts + c["span"], len(hits))] - total[starts] >= c["need"]]
            if not len(dense):
                continue
            first, past = (np.bincount(x, minlength=len(words) + 1) for x in (dense, np.minimum(dense + c["span"], len(words))))
            starts = np.flatnonzero(np.cumsum(first - past)[: len(words) - c["segment"] + 1])
            for k, at in self._aligned(c, words, starts):
                item = self.items[k][1]
                n, e = len(item), self.edits(len(item))
                for first, last in _runs(at, n + 2 * e):
                    lo, hi = max(0, first - e), min(len(words), last + n + e)
                    if self._shares(k, grams[lo:hi], hits[lo:hi]):
                        d = edit_distance_within(item, words[lo:hi])
                        if d <= e:
                            out[k] = min(d, out.get(k, d))
        return out

    @staticmethod
    def _aligned(c: dict, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items with the sorted places in the text where they would start by an equal segment."""
        codes = _walk(words, starts, c["segment"], c["seed"])
        lo, hi = (np.searchsorted(c["codes"], codes, side) for side in ("left", "right"))
        kept = hi > lo
        starts, lo, n = starts[kept], lo[kept], (hi - lo)[kept]
        upto = np.cumsum(n)
        pairs = np.zeros(0, np.int64)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
            m = n[first:last]
            row = np.repeat(lo[first:last] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            new = (c["item"][row] << 32) + (np.repeat(starts[first:last], m) - c["at"][row] + (1 << 31))
            pairs = np.unique(np.concatenate([pairs, new]))
            first = last
        item, place = pairs >> 32, (pairs & 0xFFFFFFFF) - (1 << 31)
        bounds = [*np.flatnonzero(np.diff(item, prepend=-1)), len(pairs)]
        for i, j in zip(bounds, bounds[1:], strict=False):
            yield int(item[i]), place[i:j]

    def _shares(self, k: int, grams: np.ndarray, hits: np.ndarray) -> bool:
        """Whether some window as long as a leak of the item may be holds enough of its 3-word sequences."""
        n = len(self.items[k][1])
        own = hits.copy()
        own[hits] = np.isin(grams[hits], self.own[k])
        total = np.concatenate([[0], np.cumsum(own)])
        at = np.arange(len(total))
        return bool((total[np.minimum(at + n + self.edits(n), len(own))] - total).max() >= self.shared(n))

    def short_in(self, words: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for n, table in self.short.items():
            if len(words) >= n:
                m = len(words) - n + 1
                code = np.zeros(m, _U)
                for j in range(n):
                    code ^= tc.mix(words[j : j + m] + _U(j))
                code += _U(n)
                for c in np.unique(code[np.isin(code, np.array(list(table), _U))]):
                    out.update({k: 0 for k in table[int(c)]})
        return out


def leaks(documents: DataFrame, benchmark: DataFrame, tau: float = TAU) -> DataFrame:
    """(doc_id, item_id, edits) for every document and item that it leaks."""
    spark = documents.sparkSession
    prepare(spark)
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // MAX_ITEMS_BYTES))
    out = None
    for part in range(parts):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        packed = spark.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in rows], tau))
        found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_searcher(packed), "doc_id long, item_id long, edits int")
        out = found if out is None else out.union(found)
    return out


def _searcher(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = packed.value
        for batch in batches:
            ids = batch.column("doc_id")
            rows: dict[str, list] = {"doc_id": [], "item_id": [], "edits": []}
            for chunk in tc.chunks(batch.column("text")):
                found = tc.words(chunk)
                hashes = tc.word_hashes(chunk, found, fold=True)
                grams, at = tc.windows(hashes, found.row, 3)
                hit = np.zeros(len(hashes), bool)
                maybe = np.flatnonzero(bench.filter[(grams >> _U(44)).astype(np.int64)])
                hit[at[maybe[np.isin(grams[maybe], bench.grams)]]] = True
                placed = np.zeros(len(hashes), _U)
                placed[at] = grams
                hits = np.concatenate([[0], np.cumsum(hit)])
                n = hits[found.bounds[1:]] - hits[found.bounds[:-1]]
                for i in range(chunk.rows) if bench.short or bench.unnarrowed else np.flatnonzero(n):
                    lo, hi = found.bounds[i], found.bounds[i + 1]
                    got = bench.short_in(hashes[lo:hi]) if bench.short else {}
                    if n[i] or bench.unnarrowed:
                        got |= bench.found_in(hashes[lo:hi], placed[lo:hi], hit[lo:hi])
                    for k, d in sorted(got.items()):
                        rows["doc_id"].append(ids[chunk.first + int(i)].as_py())
                        rows["item_id"].append(bench.items[k][0])
                        rows["edits"].append(d)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32())]))

    return run


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
