"""WARC archives in Zstandard frames.

A file begins with a skippable frame (magic 0x184D2A5D) that holds its dictionary, itself compressed; every record
is one frame compressed with it.  The reader loads the dictionary from the leading frame, decodes one frame per record and
validates versions, headers, lengths and digests.

Of records with equal payloads that with the largest page_id is the response; the others are revisits that refer to it
and carry no payload.  Payloads are compared by SHA-1, as archives do.

Edge cases: null html is the empty payload (equal to other empty ones); a null url is written as empty; rows that repeat
the largest page_id of a payload are all responses; a null page_id ranks below every number and is written as a
response of its own; extra columns are ignored; an empty table writes nothing and gives an empty result; very long pages
are one record each.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import store
from graphloom.llm.cluster import prepare, scratch, written

DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads smaller than this many bytes are always responses.
LEAST_REVISIT = 0
#: Payload bytes of a file; and those its dictionary is trained on (the first of the file's records), at most.
FILE_BYTES = 32 << 20
TRAINED_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
#: Payloads of more pages than this do not meet their pages in one task; so many of them are broadcast (48 MB), more are joined.
HOT_PAYLOAD = 2000
BROADCAST_PAYLOADS = 1_000_000
_NAMESPACE = 0x6C6C6D2D776172630000000000000000
_DATE = "2024-01-01T00:00:00Z"  # fixed, so that reruns write equal files


def record_id(page_id: int) -> str:
    """A URN that holds the page_id in its last 64 bits."""
    return f"<urn:uuid:{uuid.UUID(int=_NAMESPACE | (page_id & (2**64 - 1)))}>"


def nameless_id(file: str, place: int) -> str:
    """The URN of the record without a page_id at a place of a file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(int=_NAMESPACE), f'{file}#{place}')}>"


def page_of(urn: str) -> int | None:
    """The page_id in a URN; None if it holds none."""
    if uuid.UUID(urn.removeprefix("<urn:uuid:").removesuffix(">")).version == 5:
        return None
    n = uuid.UUID(urn.removeprefix("<urn:uuid:").removesuffix(">")).int
    if n >> 64 << 64 != _NAMESPACE:
        raise ValueError(f"not a record of these archives: {urn}")
    n &= 2**64 - 1
    return n - (n >> 63 << 64)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, nameless: str = "") -> bytes:
    """The bytes of a response record, or of a revisit record (headers alone) if ``refers_to`` is given; without a
    page_id its id is ``nameless``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id) if page_id is not None else nameless}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of a file: dictionary frame, then a frame for each record."""
    sample, size = [], 0
    for r in records:
        if size >= TRAINED_BYTES:
            break
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), sample).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples: records themselves are the dictionary's content
        trained = b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=9).compress(trained)
    out = io.BytesIO()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    for r in records:
        out.write(compressor.compress(r))
    return out.getvalue()


def read_archive(data: bytes) -> Iterator[dict]:
    """Each record's fields, checked; ``payload`` is None for revisits."""
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    (size,) = struct.unpack("<I", data[4:8])
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut short")
    raw = data[8 : 8 + size]
    known = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
    at, whole = 8 + size, memoryview(data)
    while at < len(data):
        # what is fed beyond a frame's end is copied, so little is fed at once, and more only to long frames
        frame, parts, step = decompressor.decompressobj(), [], 1 << 13
        while not frame.eof:
            if at >= len(data):
                raise ValueError("a record's frame is cut short")
            fed = whole[at : at + step]
            parts.append(frame.decompress(fed))
            at += len(fed) - len(frame.unused_data)
            step *= 2
        yield _parsed(b"".join(parts))


def _parsed(raw: bytes) -> dict:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, colon, v in (x.partition(": ") for x in lines[1:]) if colon}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block is not as long as its header says")
    block = rest[:n]
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("a record's block is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or fields["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("a payload is damaged")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit must refer to a record and have no payload")
    own = fields["warc-record-id"]
    return {
        "page_id": page_of(own),
        "url": fields["warc-target-uri"],
        "type": kind,
        "length": length,
        "digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write archives of all pages; returns the table of files.

    Which page is a payload's response is settled on (digest, page_id) alone, combined before its shuffle; pages
    then meet their payload's response by digest.  Only the digest is shuffled, then pages once.
    """
    prepare(pages.sparkSession)
    html = F.coalesce("html", F.lit("")).alias("html")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html)
    keyed = named.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = keyed.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
    first = written(first, "responses")
    # payloads of very many pages (at most one in HOT_PAYLOAD of all) are looked up first; the rest meet by digest
    hot = first.where(F.col("n") > HOT_PAYLOAD).select(F.col("sha").alias("_hot"), F.col("response").alias("_response"))
    joined = keyed.join(F.broadcast(hot) if hot.count() <= BROADCAST_PAYLOADS else hot, F.col("sha") == F.col("_hot"), "left")
    apart = F.when(F.col("_hot").isNull(), F.col("sha")).otherwise(F.concat("sha", F.unhex(F.hex(F.xxhash64("page_id", "url")))))
    joined = joined.withColumn("_key", apart).join(first.select(F.col("sha").alias("_key"), "response"), "_key", "left").withColumn("response", F.coalesce("_response", "response"))
    refers = F.when((F.octet_length("html") >= least) & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("response")), F.col("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # files of another attempt at the same task have other names
        task, part, held, size = TaskContext.get().taskAttemptId(), 0, [], 0

        name_of = lambda: f"{folder}/pages-{task:08d}-{part:05d}.warc.zst"

        def flush() -> pa.RecordBatch:
            name = name_of()
            store.put(name, archive(held))
            return pa.RecordBatch.from_pydict({"file": [name], "n": [len(held)]})

        for batch in batches:
            for page_id, url, text, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append(record(page_id, url, text.encode(), target, "" if page_id is not None else nameless_id(name_of(), len(held))))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, part = [], 0, part + 1
        if held:
            yield flush()

    return written(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, "file string, n long"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and html (null for revisits)."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: dict[str, list] = {f.name: [] for f in kinds}
                n = 0
                for r in read_archive(store.get(row["file"])):
                    n += 1
                    text = None if r["payload"] is None else r["payload"].decode()
                    for c, v in zip(out, (r["page_id"], r["length"], r["digest"], r["type"], r["refers_to"], r["url"], text), strict=True):
                        out[c].append(v)
                    if n % 1024 == 0:
                        yield pa.RecordBatch.from_pydict(out, schema=kinds)
                        out = {f.name: [] for f in kinds}
                if n != row["n"]:
                    raise ValueError(f"{row['file']} holds {n} records, not {row['n']}")
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    spread = files.repartition(max(4, files.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
