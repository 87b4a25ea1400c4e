"""Ranks and prefix sums within keys of any size, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.cluster import written


def ranked(df: DataFrame, key: str, order: list[str], sums: dict[str, str] | None = None, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank`` (from 0, within ``key`` by ``order``) and, for each ``sums`` entry ``out: column``,
    the sum of the column over the rows of the key that stand before.

    The rows are range-partitioned by key and order, so a hot key spans many partitions; every partition then
    adds what stands before it in the key (a table of one row per partition and key).  Ties beyond ``order``
    are broken arbitrarily but once: the ranges are written before they are read twice.
    """
    sums = sums or {}
    sorted_rows = df.repartitionByRange(*[F.col(c) for c in (key, *order)]).sortWithinPartitions(key, *order)
    placed = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *(F.sum(c).alias(f"_n_{o}") for o, c in sums.items()))
    before = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_key", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"), *(F.coalesce(F.sum(f"_n_{o}").over(before), F.lit(0)).alias(f"_{o}0") for o in sums))
    joined = placed.join(parts, placed["_part"].eqNullSafe(parts["_p"]) & placed[key].eqNullSafe(parts["_key"]))
    out = joined.withColumn("rank", F.col("_rank0") + F.col("_at") - F.col("_first"))
    if sums:
        own = Window.partitionBy("_part", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        for o, c in sums.items():
            out = out.withColumn(o, F.col(f"_{o}0") + F.coalesce(F.sum(c).over(own), F.lit(0)))
    return out.drop("_key", "_p", "_part", "_at", "_first", "_rank0", *(f"_{o}0" for o in sums))
