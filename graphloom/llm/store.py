"""Binary files in the folder that driver and executors share, written and read by Python workers."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """file:, hdfs:, s3:, gs: and the like; a path without a scheme is local."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def put(uri: str, data: bytes) -> None:
    """Write whole or not at all: under a name of this attempt's own, then renamed; a rerun replaces the file."""
    where, path = _at(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(own, compression=None) as f:
        f.write(data)
    where.move(own, path)


def get(uri: str) -> bytes:
    where, path = _at(uri)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


def opened(uri: str):
    """A file with read_at(n, offset), for random access."""
    where, path = _at(uri)
    return where.open_input_file(path)
