"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only where that is unset and the
    session is local (tests) is a temporary folder made, and removed at exit."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark.sparkContext, "_graphloom_shared", None)
    if made is None or not os.path.isdir(made):
        made = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext._graphloom_shared = made
    return f"file://{made}"


class _Scopes(threading.local):
    """Paths made so far in each open scope of a thread, the innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def tidied(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; all other tables made on the way are deleted."""
    _scopes.open.append([])
    try:
        found = make()
    finally:
        made = _scopes.open.pop()
    out = written(found, name)
    for path in made:
        removed(spark, path)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written``; only once everything made from it is itself written."""
    removed(df.sparkSession, df._written_at)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder through Hadoop, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
