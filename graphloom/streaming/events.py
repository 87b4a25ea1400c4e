"""Streams: windowed counts with a watermark, and keyed snapshots kept by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import discard, written


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum per event type and tumbling window; on a stream rows later than ``late`` are dropped, state is bounded."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour") if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Last write wins: one row per key, the greatest by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


#: Parts that a keyed snapshot is kept in; a batch rewrites those that it touches.
BUCKETS = 64


def upsert_stream(stream: DataFrame, path: str, key: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep a Parquet snapshot at ``path`` by key: each batch replaces the rows it has, in the buckets that hold its keys.

    A bucket's new rows are written aside before they replace the old ones; a batch that runs again gives the same rows."""

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = written(batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        rows = new
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            old = spark.read.parquet(path).where(F.col("bucket").isin(*touched))
            rows = written(old.join(new.select("bucket", key), ["bucket", key], "left_anti").unionByName(new), "merged")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        discard(new)
        if rows is not new:
            discard(rows)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
