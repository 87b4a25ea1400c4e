"""Toxicity by maximum-scoring segments of token log-odds, calibrated as extreme values.

1. Counts of every token (once a text) over four fifths of the labelled training rows (of at most ``MAX_TRAINING``) give
   log-odds of toxic against clean text with an informative Dirichlet prior (Monroe et al., "Fightin' Words"); every token
   whose odds are significant has the near end of its confidence interval as its score.
2. A text is the sequence of its tokens' scores less a drift.  Ruzzo and Tompa's linear scan finds all its maximal
   scoring segments: the toxic passages.
3. Under clean text a segment's score follows an extreme-value law (Karlin and Altschul): a text of m tokens has
   E = K m exp(-lambda S) segments of score S by chance.  lambda comes from the clean token distribution, K from
   clean rows of the fifth that the odds were not learnt from, as does a logistic curve that turns the evidence into a
   probability.

Only texts are inputs of a score.  Edge cases: null and empty texts have no segment and the score of no evidence;
labels that are null, of unknown documents or missing altogether are left out, and without both classes every score
is 0; repeated rows are scored alike; extra columns are ignored; an empty table gives an empty result; very long texts are
scored whole, one at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.cluster import prepare, written

#: Weight of the Dirichlet prior, as a share of all counts.
PRIOR = 0.02
LEAST_Z = 3.0
DRIFT = 0.25
HIGHEST = 6.0
MOST_EVIDENCE = 30.0
#: Labelled rows that are learnt from, at most (chosen by the hash of doc_id): small enough to broadcast to the texts.
MAX_TRAINING = 500_000
#: Labelled rows that the calibration curve is fitted on, at most.
MAX_CALIBRATION = 20_000
#: Of the labelled rows one in so many is kept for calibration.
CALIBRATION_SHARE = 5
_COUNTED_AT_ONCE = 1 << 20
_U = np.uint64
#: Tokens are runs of letters, digits and bytes of other alphabets.
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class ToxicityModel:
    tokens: np.ndarray
    scores: np.ndarray
    drift: float = DRIFT
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    shift: float = -30.0

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log of the chance that clean text of this length has such segments; the best one counts most."""
        total = 0.0
        for rank, s in enumerate(sorted((s for _, _, s in segments), reverse=True)):
            e = self.rate * s - self.log_k - math.log(max(n, 1))  # -ln of the expected number of such segments
            e += math.lgamma(rank + 2)  # r-th best: E**r / r!
            if e <= 0:
                break
            total += e if rank == 0 else 0.5 * e
        return min(total, MOST_EVIDENCE)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def maximal_segments(positions: np.ndarray, values: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Ruzzo-Tompa: all maximal scoring segments (first, past the last, score) of a sequence whose entries are ``values``
    at ``positions`` and ``-drift`` elsewhere.

    Every segment keeps the one that it was held against: the nearest before it that starts lower.  Whoever starts lower still
    skips all between the two, so the scan is linear in the entries.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, cumulative score before it and at its end, the one it was held against
    total, at = 0.0, 0
    for p, v in zip(positions.tolist(), values.tolist(), strict=True):
        total -= drift * (p - at)
        at = p + 1
        if v <= 0:
            total += v
            continue
        start, left, right = p, total, total + v
        total = right
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, p + 1, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            below = found[j][4]
            del found[j:]
            j = below
    return [(s, e, r - b) for s, e, b, r, _ in found]


def _tokens(chunk: tc.Chunk) -> tuple[tc.Words, np.ndarray]:
    found = tc.words(chunk, _BREAKS)
    return found, tc.word_hashes(chunk, found, fold=True)


def _segmented(texts: pa.Array, model: ToxicityModel) -> Iterator[tuple[int, int, list[tuple[int, int, float]], tc.Words, tc.Chunk]]:
    """For each text its index, number of tokens and segments."""
    for chunk in tc.chunks(texts):
        found, hashes = _tokens(chunk)
        if len(model.tokens):
            at = np.minimum(np.searchsorted(model.tokens, hashes), len(model.tokens) - 1)
            hit = np.flatnonzero(model.tokens[at] == hashes)
            value = model.scores[at[hit]] - model.drift
        else:
            hit, value = np.zeros(0, np.int64), np.zeros(0)
        edges = np.searchsorted(hit, found.bounds)
        for i in range(chunk.rows):
            own = slice(edges[i], edges[i + 1])
            segments = maximal_segments(hit[own] - found.bounds[i], value[own], model.drift) if edges[i] < edges[i + 1] else []
            yield chunk.first + i, int(found.counts[i]), segments, found, chunk


def training(doc_id: str = "doc_id") -> Column:
    """Rows that may be learnt from: crc32 of the id's text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0)) != 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = [[], []]
    n = 0

    def flush() -> pa.RecordBatch:
        parts = [np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, _U), np.zeros(0, np.int64)) for h in held]
        every = np.unique(np.concatenate([p[0] for p in parts]))
        out = []
        for token, count in parts:
            own = np.zeros(len(every), np.int64)
            own[np.searchsorted(every, token)] = count
            out.append(own)
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(out[0]), pa.array(out[1])], ["token", "clean", "toxic"])

    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), bool)
        for chunk in tc.chunks(batch.column("text")):
            found, hashes = _tokens(chunk)
            order = np.lexsort((hashes, found.row))  # a token counts once in a text
            once = np.ones(len(order), bool)
            once[1:] = (hashes[order][1:] != hashes[order][:-1]) | (found.row[order][1:] != found.row[order][:-1])
            hashes, found.row = hashes[order][once], found.row[order][once]
            of = toxic[chunk.first : chunk.first + chunk.rows][found.row] if len(hashes) else np.zeros(0, bool)
            held[0].append(hashes[~of])
            held[1].append(hashes[of])
            n += len(hashes)
            if n >= _COUNTED_AT_ONCE:
                yield flush()
                held, n = [[], []], 0
    if n:
        yield flush()


def _measured(texts: DataFrame, model: ToxicityModel, measure) -> list[tuple[bool, int, float]]:
    """toxic, number of tokens and a number that ``measure`` makes of the segments, for each of a bounded set of rows."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for _, m, segments, _, _ in _segmented(batch.column("text"), shared.value):
                n.append(m)
                out.append(measure(segments, m))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int64()), pa.array(out, pa.float64())], ["toxic", "n", "x"])

    rows = texts.mapInArrow(run, "toxic boolean, n long, x double").toArrow()
    return sorted(zip(*(rows.column(c).to_pylist() for c in ("toxic", "n", "x")), strict=True))


def fit_toxicity(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    spark = documents.sparkSession
    prepare(spark)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(training()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING), "labels")
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(CALIBRATION_SHARE)) == 0
    rows = documents.select("doc_id", "text").join(F.broadcast(known.where(~apart)), "doc_id")
    counts = rows.select("toxic", "text").mapInArrow(_counts, "token long, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    prior, mass = PRIOR * (F.col("clean") + F.col("toxic")), PRIOR * (F.col("c") + F.col("t"))
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.col(n) + mass - F.col(y) - prior))
    scored = counts.join(F.broadcast(totals.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))
    scored = scored.where("c > 0 AND t > 0").withColumn("odds", odds("toxic", "t") - odds("clean", "c")).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
    # no more than the training rows' distinct tokens, whose number their bound bounds
    top = scored.where(F.abs("z") >= LEAST_Z).select("token", (F.col("odds") * (1 - 1.96 / F.abs("z"))).alias("score"), "clean", "c").orderBy("token").toArrow()
    if not top.num_rows:
        return ToxicityModel(np.zeros(0, _U), np.zeros(0))
    token, score, clean_n, c = (top.column(x).to_numpy() for x in ("token", "score", "clean", "c"))
    token = token.view(_U)
    order = np.argsort(token)
    model = ToxicityModel(token[order], np.clip(score[order], -HIGHEST, HIGHEST))
    # lambda: the root of sum p exp(lambda s) = 1 over the clean distribution; tokens without a score drift
    p = (clean_n[order] + 0.5) / (c[0] + 0.5 * len(token))
    s = model.scores - model.drift
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + (1 - p.sum()) * math.exp(-x * model.drift) - 1)
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    model.rate = (lo + hi) / 2

    chosen = known.where(apart).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_CALIBRATION)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    best = _measured(texts, model, lambda segments, n: max((x for _, _, x in segments), default=0.0))
    clean = [model.rate * x - math.log(max(n, 1)) for toxic, n, x in best if not toxic and n]
    if clean:
        model.log_k = float(np.quantile(clean, 0.99)) + math.log(0.01)  # one clean text in a hundred lies above E = 0.01
    sample = _measured(texts, model, model.evidence)
    y, x = np.array([toxic for toxic, _, _ in sample], float), np.array([v for _, _, v in sample])
    if len(set(y.tolist())) == 2:
        scale, w, b = float(x.std()) or 1.0, 1.0, 0.0
        for _ in range(60):  # Newton, slightly damped
            q = 1 / (1 + np.exp(-np.clip(w * x / scale + b, -30, 30)))
            g = np.array([((q - y) * x / scale).sum() + 0.01 * w, (q - y).sum()])
            v = q * (1 - q) + 1e-6
            h = np.array([[(v * (x / scale) ** 2).sum() + 0.01, (v * x / scale).sum()], [(v * x / scale).sum(), v.sum()]])
            step = np.linalg.solve(h, g)
            w, b = w - 0.8 * step[0], b - 0.8 * step[1]
        model.slope, model.shift = float(w) / scale, float(b)
    return model


def toxicity(documents: DataFrame, model: ToxicityModel, chance: float = 0.01) -> DataFrame:
    """doc_id, score and passages (code-point spans with E below ``chance``, and their scores), a row per document."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            evidence, passages = [], []
            for i, n, segments, found, chunk in _segmented(batch.column("text"), own):
                evidence.append(own.evidence(segments, n))
                kept = []
                for first, past, s in segments:
                    if own.rate * s - own.log_k - math.log(max(n, 1)) >= -math.log(chance):
                        row = i - chunk.first
                        lo, at = int(chunk.offsets[row]), int(found.bounds[row])
                        a, b = int(found.starts[at + first]), int(found.ends[at + past - 1])
                        start = int(((chunk.data[lo:a] & 0xC0) != 0x80).sum())
                        kept.append({"start": start, "end": start + int(((chunk.data[a:b] & 0xC0) != 0x80).sum()), "score": s})
                passages.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(np.array(evidence, float)), pa.float64()), pa.array(passages, span)], ["doc_id", "score", "passages"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start: long, end: long, score: double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity(documents, fit_toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (~training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
