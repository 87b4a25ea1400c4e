"""Token files as directly addressable codes (DAC).

An id is cut into 8-bit chunks, lowest first.  Level 0 holds the lowest chunk of every id, with a bit that says
whether more follow; level 1 the next chunk of those that go on, and so on.  A rank directory over each level's
bits tells where an id's next chunk stands, so any token is read without decoding others.

A file: the magic, a header of six little-endian 64-bit integers (ids, documents, levels, shard number, reserved,
length of the body), then for the documents their ids, null flags and first positions, then for each level its
size, chunks, bits and rank directory; last a CRC-32 of all that.

Edge cases: null or empty texts are the end id alone; rows that repeat a doc_id keep their own entries, in an order of
their texts' hashes; null doc_ids come first; an empty table writes no file and gives an empty result; very long texts are encoded whole; ids of up
to 32 bits fit (four levels).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import store
from graphloom.llm.cluster import prepare, scratch, written
from graphloom.llm.textcore import give_back
from graphloom.llm.tokens import encoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Ids of a file, about; a writer holds 4 bytes for each.
SHARD_IDS = 1 << 21
_MAGIC = b"GLDAC\x00\x01\x00"
_BLOCK = 512  # bits between two entries of a rank directory


def encoded(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, shard: int = 0) -> bytes:
    """The bytes of a file; ``starts`` has the position of each document's first id and the end."""
    body = [
        np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
        np.array([i is None for i in doc_ids], np.uint8).tobytes(),
        np.asarray(starts, "<i8").tobytes(),
    ]
    levels, rest = 0, np.asarray(ids, np.uint32)
    while levels == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)])[: max(1, len(blocks))]
        body += [struct.pack("<q", len(rest)), (rest & np.uint32(0xFF)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[more]
        rest >>= np.uint32(8)
        levels += 1
    body.insert(0, _MAGIC + struct.pack("<6q", len(ids), len(doc_ids), levels, shard, 0, sum(map(len, body))))
    crc = 0
    for part in body:
        crc = zlib.crc32(part, crc)
    return b"".join([*body, struct.pack("<I", crc)])


class TokenFile:
    """A token file: any token or slice by position, from bytes or from a file opened for random access."""

    def __init__(self, source):
        self._read = (lambda n, at: source[at : at + n]) if isinstance(source, (bytes, memoryview)) else source.read_at
        head = self._read(56, 0)
        if head[:8] != _MAGIC:
            raise ValueError("not a token file")
        self.n_ids, self.n_docs, levels, self.shard, _, body = struct.unpack("<6q", head[8:])
        self.end = 56 + body
        at = 56 + 17 * self.n_docs + 8
        self._levels: list[tuple[int, int, int, int]] = []  # ids, then where chunks, bits and ranks are
        for _ in range(levels):
            (n,) = struct.unpack("<q", self._read(8, at))
            chunks, bits = at + 8, at + 8 + n
            ranks = bits + (n + 7) // 8
            self._levels.append((n, chunks, bits, ranks))
            at = ranks + 4 * max(1, -(-n // _BLOCK))
        if at != self.end:
            raise ValueError("token file of a wrong length")

    @classmethod
    def checked(cls, data: bytes) -> TokenFile:
        out = cls(data)
        if len(data) != out.end + 4 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("token file is damaged")
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids = np.frombuffer(self._read(8 * self.n_docs, 56), "<i8").tolist()
        null = self._read(self.n_docs, 56 + 8 * self.n_docs)
        starts = np.frombuffer(self._read(8 * self.n_docs + 8, 56 + 9 * self.n_docs), "<i8")
        return [None if z else i for i, z in zip(ids, null, strict=True)], starts

    def _ones(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, _, bits, ranks = self._levels[level]
        block = i // _BLOCK
        (known,) = struct.unpack("<I", self._read(4, ranks + 4 * block)) if i % _BLOCK or i < self._levels[level][0] else (None,)
        raw = int.from_bytes(self._read((i % _BLOCK + 7) // 8, bits + block * (_BLOCK // 8)), "little")
        return known + (raw & ((1 << (i % _BLOCK)) - 1)).bit_count()

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for level, (_, chunks, bits, _) in enumerate(self._levels):
            out |= self._read(1, chunks + i)[0] << (8 * level)
            if not self._read(1, bits + i // 8)[0] >> (i % 8) & 1:
                break
            i = self._ones(level, i)
        return out

    def ids(self) -> np.ndarray:
        """All ids."""
        out, at = np.zeros(self.n_ids, np.uint32), np.arange(self.n_ids)
        for level, (n, chunks, bits, _) in enumerate(self._levels):
            out[at] |= np.frombuffer(self._read(n, chunks), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            at = at[np.unpackbits(np.frombuffer(self._read((n + 7) // 8, bits), np.uint8), count=n, bitorder="little").astype(bool)]
        return out


def encoded_texts(documents: DataFrame, path: str, bounds: list[int]) -> DataFrame:
    """bucket, doc_id, h (hash of the text) and ids of every document: little-endian, two bytes each where the vocabulary allows, else
    four.  The bucket is the number of ``bounds`` up to the doc_id, -1 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, edges = encoder(path), np.array(bounds, np.int64)
        kind = id_kind(of)
        for batch in batches:
            own = batch.column("doc_id")
            bucket = np.searchsorted(edges, pc.fill_null(own, 0).to_numpy(zero_copy_only=False), "right")
            bucket[own.is_null().to_numpy(zero_copy_only=False)] = -1
            ids = [x.astype(kind).tobytes() for x in of.batch(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), own, batch.column("h"), pa.array(ids, pa.binary())], ["bucket", "doc_id", "h", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "bucket long, doc_id long, h long, ids binary")


def id_kind(of) -> str:
    return "<u2" if of.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def write_token_files(documents: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, and write files in ascending order of doc_id; returns the table of shards with their first positions.

    Texts are encoded where they are read, and only ids are shuffled, by buckets of doc_ids whose bounds are quantiles of the
    doc_id column alone: a bucket's files hold about ``shard_ids`` ids each.
    """
    spark = documents.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = documents.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(q) for q in quantiles})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, attempt = id_kind(encoder(path)), TaskContext.get().taskAttemptId()
        end = np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        starts, shard, bucket = [0], 0, None

        def flush() -> pa.RecordBatch:
            # files of another attempt at the same task have other names
            name = f"{folder}/tokens-{bucket + 1:06d}-{attempt:08d}-{shard:06d}.dac"
            together = np.concatenate(held)
            held.clear()
            store.put(name, encoded(together, ids, np.array(starts), shard))
            del together
            give_back()
            return pa.RecordBatch.from_pydict({"task": [bucket], "shard": [shard], "file": [name], "n_docs": [len(ids)], "n_ids": [starts[-1]]})

        for batch in batches:
            for at, i, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if at != bucket:
                    if ids:
                        yield flush()
                    held, ids, starts, shard, bucket = [], [], [0], 0, at
                own = np.frombuffer(raw, kind).astype(np.uint32)
                held += (own, end)
                ids.append(i)
                starts.append(starts[-1] + 1 + len(own))
                if starts[-1] >= shard_ids:
                    yield flush()
                    held, ids, starts, shard = [], [], [0], shard + 1
        if ids:
            yield flush()

    ordered = encoded_texts(documents, path, bounds).repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "h").select("bucket", "doc_id", "ids")
    shards = written(ordered.mapInArrow(run, "task long, shard long, file string, n_docs long, n_ids long"), "shards")
    # a row per file: positions of tasks, then of the files of a task
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("_n")).select("task", F.coalesce(F.sum("_n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("_within", within).join(tasks, "task").select("task", "shard", "file", "n_docs", "n_ids", (F.col("_before") + F.col("_within")).alias("first"))


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile.checked(store.get(row["file"]))
                if (file.n_ids, file.n_docs) != (row["n_ids"], row["n_docs"]):
                    raise ValueError(f"{row['file']}: not the file that was written")
                ids = file.ids().astype("<u4")
                docs, starts = file.documents()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts[:-1] + row["first"]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.select("file", "n_docs", "n_ids", "first").repartition(max(4, shards.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents' ids to files in ``folder`` (by default in the shared folder) and read them back."""
    folder = folder or scratch(documents.sparkSession, "tokens")
    return read_token_files(write_token_files(documents, folder, path or vocabulary_path(VOCABULARY)))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
