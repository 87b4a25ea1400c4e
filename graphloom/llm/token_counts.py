"""Token counts by a two-tier lookup on the map side.

The lengths of the corpus's most frequent pre-tokens are a compact table (sorted hashes and lengths) that every worker
gets; other pre-tokens are encoded once per worker and kept in its own bounded cache.  Pre-tokens are never shuffled:
each map task hands on a bounded summary of its frequent ones, from which the table is made.

Edge cases: a null or empty text has 0 bytes and 0 tokens; every row is counted by itself, so ties, repeated rows
and extra columns do not matter; an empty table gives an empty result; very long texts are counted whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.cluster import prepare
from graphloom.llm.tokens import Cache, encoder, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Entries of the table of frequent pre-tokens (at most LONGEST bytes each), and of each task's summary.
TABLE_SIZE = 1 << 15
SUMMARY_SIZE = 1 << 13
LONGEST = 64
_COUNTED_AT_ONCE = 300_000


def _hashed(pieces: list[bytes]) -> np.ndarray:
    for chunk in tc.chunks(pa.array(pieces, pa.binary()).cast(pa.string()), 1 << 62):
        return tc.span_hash(chunk.prefix_hash(), chunk.offsets[:-1], chunk.offsets[1:])
    return np.zeros(0, tc.U64)


def frequent_lengths(documents: DataFrame, path: str, size: int = TABLE_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and token counts of the most frequent pre-tokens of all documents: at most ``size`` entries."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        seen: dict[int, int] = {}
        spelt: dict[int, bytes] = {}
        for batch in batches:
            for chunk, raw in of.chunks(batch.column("text")):
                starts, ends, hashes, _ = of.pretokens(chunk, raw)
                keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                data = chunk.data.tobytes()
                for key, i, m in zip(keys.tolist(), first.tolist(), n.tolist(), strict=True):
                    if key in seen:
                        seen[key] += m
                    elif ends[i] - starts[i] <= LONGEST:
                        seen[key] = m
                        spelt[key] = data[starts[i] : ends[i]]
            if len(seen) > _COUNTED_AT_ONCE:  # rare ones so far give way; the table only has to hold frequent ones
                seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: _COUNTED_AT_ONCE // 4])
                spelt = {key: spelt[key] for key in seen}
        top = sorted(((n, spelt[key]) for key, n in seen.items() if n > 1), reverse=True)[:SUMMARY_SIZE]
        yield pa.RecordBatch.from_arrays([pa.array([p for _, p in top], pa.binary()), pa.array([n for n, _ in top], pa.int64())], ["piece", "n"])

    counted = documents.select("text").mapInArrow(summed, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    of = encoder(path)
    pieces = [bytes(r.piece) for r in counted.orderBy(F.desc("n"), "piece").limit(size).collect()]
    keys = _hashed(pieces)
    order = np.argsort(keys)
    return keys[order], np.array([len(x) for x in of.pieces(pieces)], np.uint16)[order]


def token_counts(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens above ``limit``), a row per document."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(frequent_lengths(documents, path))  # at most 330 KB

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (known, lengths) = encoder(path), shared.value
        own = Cache(lambda pieces: [[len(x)] for x in of.pieces(pieces)])
        for batch in batches:
            n = []
            for chunk, raw in of.chunks(batch.column("text")):
                starts, ends, hashes, settled = of.pretokens(chunk, raw)
                count = np.zeros(len(hashes), np.int64)
                miss = np.ones(len(hashes), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    miss = known[at] != hashes
                    count = np.where(miss, 0, lengths[at]).astype(np.int64)
                which = np.flatnonzero(miss)
                count[which] = own.values_of(chunk.data, starts[which], ends[which], hashes[which])[0]
                upto = np.concatenate([[0], np.cumsum(count)])
                sums = np.diff(upto[np.searchsorted(starts, chunk.offsets)])
                for i in np.flatnonzero(~settled):
                    sums[i] = len(of.whole(raw.data[raw.offsets[i] : raw.offsets[i + 1]].tobytes().decode()))
                n.append(sums)
            tokens = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(VOCABULARY))
