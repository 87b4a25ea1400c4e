"""Texts in a few large files, read one by one: bytes end to end, and an index of where each text lies.

Every task writes files of its own, named by attempt, of about ``FILE_BYTES``; the index (a Parquet table in order of ids) is
written by the same job, so it names just the files of attempts that counted.  A reader looks ids up in the index and reads
their byte ranges, next to each other where they are; a checksum is compared for each.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 64 << 20
_INDEX = "id string, file string, offset long, length int, crc long, metadata string"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def write_docstore(documents: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The index of ``documents(id, text, metadata)`` written below ``folder``: a null text is empty, a row without id is left out,
    of rows that repeat an id the one of the smallest text stays.  ``metadata`` is any string, JSON for one."""
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size = None, "", 0
        try:
            for batch in batches:
                rows = []
                for key, text, data in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "metadata")), strict=True):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        name, size = f"texts-{uuid.uuid4().hex}.bin", 0
                        where, path = _at(f"{folder}/bytes/{name}")
                        where.create_dir(path.rpartition("/")[0], recursive=True)
                        out = where.open_output_stream(path, compression=None)
                    raw = (text or "").encode("utf-8", "replace")
                    out.write(raw)
                    rows.append((key, name, size, len(raw), zlib.crc32(raw), data))
                    size += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["id", "file", "offset", "length", "crc", "metadata"]) if rows else batch.slice(0, 0)
        finally:
            if out is not None:
                out.close()

    rows = documents.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), (F.col("metadata").cast("string") if "metadata" in documents.columns else F.lit(None).cast("string")).alias("metadata"))
    once = rows.groupBy("id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "metadata")).alias("d")).select("id", "d.*")
    # sorted by id within each task, and ids in ranges: neighbours in the index are neighbours in a file
    once.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")
    return documents.sparkSession.read.schema(_INDEX).parquet(f"{folder}/index")


class BrokenDocstore(RuntimeError):
    pass


def read_range(folder: str, file: str, offset: int, length: int, crc: int) -> str:
    """One text by its entry of the index."""
    where, path = _at(f"{folder.rstrip('/')}/bytes/{file}")
    with where.open_input_file(path) as f:
        return _text(f, file, offset, length, crc)


def _text(f, file: str, offset: int, length: int, crc: int) -> str:
    raw = f.read_at(length, offset) if length else b""
    if len(raw) != length or zlib.crc32(raw) != crc:
        raise BrokenDocstore(f"{file} at {offset}: {len(raw)} of {length} bytes, or not those that were written")
    return raw.decode("utf-8")


def fetch(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """id, text, metadata of the ``ids(id)`` that the store holds, each once; only their byte ranges are read."""
    folder = folder.rstrip("/")
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    wanted = index.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        try:
            for batch in batches:
                texts = []
                for file, offset, length, crc in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "crc")), strict=True):
                    if opened[0] != file:
                        if opened[1] is not None:
                            opened[1].close()
                        where, path = _at(f"{folder}/bytes/{file}")
                        opened = (file, where.open_input_file(path))
                    texts.append(_text(opened[1], file, offset, length, crc))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), batch.column("metadata")], names=["id", "text", "metadata"])
        finally:
            if opened[1] is not None:
                opened[1].close()

    # by file and a part of it, so that one file's texts are read by few tasks, in order of their places
    dealt = wanted.withColumn("_part", F.floor(F.col("offset") / (8 << 20))).repartition("file", "_part").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "id string, text string, metadata string")


def fetch_one(spark: SparkSession, folder: str, key: str) -> str | None:
    """The text of an id: the index is read where its statistics allow the id."""
    row = spark.read.schema(_INDEX).parquet(f"{folder.rstrip('/')}/index").where(F.col("id") == key).first()
    return None if row is None else read_range(folder, row.file, row.offset, row.length, row.crc)
