"""Quality rules: counting rules, then a hashed n-gram logistic regression with calibrated probabilities.

Edge cases: a null or empty text has no words and fails the base rule; rows are independent, so ties, repeated
rows and extra columns change nothing; with no usable labelled rows of both classes the model gives every
document probability 1 and only the base rule decides; a carried column that bears the name of an output comes back
with underscores before it; very long texts are counted whole, one at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.cluster import free_names, prepare

#: Labelled rows that the classifier is fitted on, at most; chosen by the hash of doc_id.
MAX_LABELLED = 1000
#: Documents whose calibrated probability of good quality is below this are rejected.
MIN_PROBABILITY = 0.25
_BITS = 12
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_GRAMS = (3, 4)


@dataclass
class QualityModel:
    """Weights by feature family and slot; ``slope`` and ``shift`` calibrate the margin (Platt)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _families(chunk: tc.Chunk, found: tc.Words, hashes: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each feature family the slot of every occurrence and the bounds of each text's occurrences."""
    shift = tc.U64(64 - _BITS)
    yield (hashes >> shift).astype(np.int64), found.bounds
    pairs, at = tc.windows(hashes, found.row, 2)
    yield (pairs >> shift).astype(np.int64), np.searchsorted(at, found.bounds)
    n = len(chunk.data)
    for g in _GRAMS:
        starts = np.arange(max(0, n - g + 1))
        slots = (tc.span_hash(prefix, starts, starts + g) >> shift).astype(np.int64)
        inside = np.ones(len(slots), bool)
        for back in range(1, g):  # windows that would run into the next text
            at = chunk.offsets[1:-1] - back
            inside[at[(at >= 0) & (at < len(slots))]] = False
        kept = np.flatnonzero(inside)
        yield slots[kept], np.searchsorted(kept, chunk.offsets)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def margins(model: QualityModel, chunk: tc.Chunk, found: tc.Words, hashes: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    out = np.full(chunk.rows, model.bias)
    for family, (slots, bounds) in enumerate(_families(chunk, found, hashes, prefix)):
        out += _sums(model.weights[family][slots], bounds) / np.maximum(1, np.diff(bounds))
    return out


def base_counts(chunk: tc.Chunk, found: tc.Words, hashes: np.ndarray, prefix: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a chunk."""
    heads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[chunk.data])])
    out = {
        "n_words": found.counts,
        "word_chars": _sums(heads[found.ends] - heads[found.starts], found.bounds),
        "n_symbols": symbols[chunk.offsets[1:]] - symbols[chunk.offsets[:-1]],
    }
    # Lines: cut at \n and at the ends of texts; only lines that hold the start of a word count.
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.unique(np.concatenate([chunk.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(chunk.data)]
    row = np.searchsorted(chunk.offsets, starts, "right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(chunk.data)]]), chunk.offsets[row + 1])
    ends = ends - ((ends > starts) & (chunk.data[ends - 1] == 10)) if len(ends) else ends
    has_word = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    lines = tc.span_hash(prefix, starts, ends)
    order = np.lexsort((lines, row))
    again = np.zeros(len(order), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][again], minlength=chunk.rows)
    shingles, at = tc.windows(hashes, found.row, 5)
    covered = np.zeros(len(hashes) + 1, np.int64)
    edges = np.searchsorted(at, found.bounds)
    for i in np.flatnonzero(np.diff(edges) > 1):
        own = shingles[edges[i] : edges[i + 1]]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            first = at[edges[i] : edges[i + 1]][twice]
            covered[first] += 1
            np.subtract.at(covered, np.minimum(first + 5, len(hashes)), 1)
    out["n_repeat_words"] = _sums((np.cumsum(covered)[: len(hashes)] > 0).astype(np.int64), found.bounds)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse relative frequencies of labelled texts, for fitting."""
    for batch in batches:
        labels = batch.column("label")
        rows = {"label": [], "slots": [], "values": []}
        for chunk in tc.chunks(batch.column("text")):
            found = tc.words(chunk)
            prefix = chunk.prefix_hash()
            hashes = tc.word_hashes(chunk, found, prefix=prefix)
            families = list(_families(chunk, found, hashes, prefix))
            for i in range(chunk.rows):
                at, value = [], []
                for family, (slots, bounds) in enumerate(families):
                    own = slots[bounds[i] : bounds[i + 1]]
                    used, n = np.unique(own, return_counts=True)
                    at.append(used + (family << _BITS))
                    value.append(n / max(1, len(own)))
                rows["label"].append(labels[chunk.first + i].as_py())
                rows["slots"].append(np.concatenate(at).astype(np.int32).tobytes())
                rows["values"].append(np.concatenate(value).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("label", pa.int32()), ("slots", pa.binary()), ("values", pa.binary())]))


class _Rows:
    """A sparse matrix by rows."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray], width: int):
        self.width, self.counts = width, np.array([len(x) for x in slots])
        self.slots = np.concatenate([*slots, np.zeros(0, np.int32)]).astype(np.int32)
        self.values = np.concatenate([*values, np.zeros(0, np.float32)]).astype(np.float64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])

    def times(self, w: np.ndarray) -> np.ndarray:
        return _sums(self.values * w[self.slots], self.bounds)

    def summed(self, by: np.ndarray) -> np.ndarray:
        """For each column the sum of its values, each times its row's number."""
        return np.bincount(self.slots, self.values * np.repeat(by, self.counts), self.width)


def _descend(x: _Rows, y: np.ndarray, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows, classes weighted equally."""
    w, b = np.zeros(x.width), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        error = weight * (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - y)
        g = np.concatenate([x.summed(error) + decay * w, [error.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model of all rows (label, slots, values)."""
    families = 2 + len(_GRAMS)
    rows = [r for batch in batches for r in zip(batch.column("slots").to_pylist(), batch.column("values").to_pylist(), batch.column("label").to_pylist(), strict=True)]
    rows.sort()  # not as executors return them
    order = np.random.default_rng(7).permutation(len(rows))
    cut = len(rows) * 3 // 4  # the first rows fit the weights, the rest the calibration
    y = np.array([rows[i][2] for i in order], np.float64)
    weights, b, slope, shift = np.zeros(families << _BITS, np.float32), 0.0, 0.0, 30.0
    if len(set(y[:cut].tolist())) == 2:
        slots, values = ([np.frombuffer(rows[i][k], kind) for i in order] for k, kind in ((0, np.int32), (1, np.float32)))
        every = _Rows(slots, values, families << _BITS)
        scale = 1 / np.sqrt(every.summed(np.ones(len(rows))) / len(rows) + 1e-5)
        values = [v * scale[k] for k, v in zip(slots, values, strict=True)]
        w, b = _descend(_Rows(slots[:cut], values[:cut], every.width), y[:cut], 150, 1e-5)
        slope, shift = 1.0, 0.0
        if len(set(y[cut:].tolist())) == 2:
            margin = _Rows(slots[cut:], values[cut:], every.width).times(w) + b
            spread = float(margin.std()) or 1.0
            one = [np.zeros(1, np.int32)] * len(margin)
            (s,), shift = _descend(_Rows(one, list((margin / spread).reshape(-1, 1)), 1), y[cut:], 200, 1e-3)
            slope, shift = float(s) / spread, float(shift)
        weights = (w * scale).astype(np.float32)
    yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [b], "slope": [slope], "shift": [shift]})


def fit_quality(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit on at most ``max_labelled`` labelled rows, in one task; three quarters fit the weights, the rest the calibration."""
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where("_id IS NOT NULL AND label IS NOT NULL").groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    joined = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    prepare(documents.sparkSession)
    rows = joined.select("label", "text").mapInArrow(_features, "label int, slots binary, values binary")
    # rows that repeat a labelled doc_id count too, one of each text
    rows = rows.dropDuplicates().coalesce(1).mapInArrow(_fitted, "weights binary, bias double, slope double, shift double")
    got = rows.first()
    families = 2 + len(_GRAMS)
    if got is None:
        return QualityModel(np.zeros((families, 1 << _BITS), np.float32), 0.0, 0.0, 30.0)
    return QualityModel(np.frombuffer(got.weights, np.float32).reshape(families, -1), got.bias, got.slope, got.shift)


_COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]


def quality_rules(documents: DataFrame, model: QualityModel, min_probability: float = MIN_PROBABILITY, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with the base counts, base_failed, probability and kept, a row per document."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 families x 4096 slots: 64 KB at any size
    own = [c for c, _ in _COLUMNS] + ["base_failed", "probability", "kept"]
    names = [f"_c{i}" for i in range(len(carry))]
    text = names[carry.index("text")] if "text" in carry else "_text"
    frame = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)), *([] if "text" in carry else [F.col("text").alias("_text")]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in names] + [f"{c} {k}" for c, k in _COLUMNS] + ["base_failed boolean", "probability double", "kept boolean"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts: dict[str, list] = {c: [] for c, _ in _COLUMNS}
            margin = []
            for chunk in tc.chunks(batch.column(text)):
                found = tc.words(chunk)
                prefix = chunk.prefix_hash()
                hashes = tc.word_hashes(chunk, found, prefix=prefix)
                for c, v in base_counts(chunk, found, hashes, prefix).items():
                    parts[c].append(v)
                margin.append(margins(model, chunk, found, hashes, prefix))
            if not batch.num_rows:
                continue
            n = {c: np.concatenate(v).astype(np.int64) for c, v in parts.items()}
            failed = (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])
            p = model.probability(np.concatenate(margin))
            arrays = [batch.column(c) for c in names] + [pa.array(n[c]) for c, _ in _COLUMNS] + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= min_probability))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *own])

    return frame.mapInArrow(scored, schema).toDF(*free_names(carry, own), *own)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents, fit_quality(documents, labels))
