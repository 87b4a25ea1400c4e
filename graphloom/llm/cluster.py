"""What the operators need from the session: shared folders, and Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.llm.textcore import ARROW_BYTES, ARROW_ROWS
from graphloom.sources.shared import discard, removed, scratch, shared_dir, tidied, written  # noqa: F401


def prepare(spark: SparkSession) -> None:
    """Smaller Arrow batches, in rows and in bytes, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def free_names(carried: tuple[str, ...], own: list[str]) -> list[str]:
    """Names for carried columns, with underscores before those that an operator's own columns bear."""
    taken, out = {c.lower() for c in own}, []
    for c in carried:
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out
