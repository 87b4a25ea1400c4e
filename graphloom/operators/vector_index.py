"""Nearest vectors by lists: vectors stand with the centroid they are nearest to, and a search reads the lists near its query.

Centroids are fitted on a bounded sample; every vector is in a list.  How many lists to read is measured: the fewest that find
``RECALL`` of the exact neighbours of sampled vectors.  With all lists the search is exact.  The store is a folder of lists, so
that a search reads those it needs; additions append to it, deletions are a table of ids until the store is written anew.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, and those of them that the number of lists to read is measured by.
SAMPLE, MEASURED = 20_000, 200
ROUNDS = 12
RECALL = 0.95
#: Vectors a list has on average, until there are MOST_LISTS of them.
PER_LIST, MOST_LISTS = 2_000, 4_096
MEASURE_K = 10
#: Vectors of a list and queries that meet in one group, and distances that a task holds at once.
VECTORS_AT_ONCE, QUERIES_AT_ONCE, CELLS_AT_ONCE = 16_384, 4_096, 4_000_000


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    if not len(column):
        return np.zeros((0, 1))
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError(f"vectors of lengths {sorted(lengths.to_pylist())}")
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _nearest(a: np.ndarray, b: np.ndarray, at_once: int = 2_048) -> np.ndarray:
    return np.concatenate([_distances(a[i : i + at_once], b).argmin(1) for i in range(0, len(a), at_once)]) if len(a) else np.zeros(0, np.int64)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds; a list that runs empty starts again at the vector farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if (empty := np.flatnonzero(counts == 0)).size:
            far = np.argsort(-((sample - centres[own]) ** 2).sum(1))[: empty.size]
            centres[empty] = sample[far]
    return centres


def measured_probes(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, k: int = MEASURE_K, queries: int = MEASURED) -> int:
    """The fewest lists in which ``recall`` of the sample's own nearest neighbours lie."""
    own = _nearest(sample, centres)
    asked = sample[: min(queries, len(sample))]
    d = _distances(asked, sample)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
    order = np.argsort(_distances(asked, centres), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape).copy(), axis=1)
    found = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) + 1


def nearest(wanted: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``wanted``, places in ``held`` and distances of the ``k`` nearest to each row, the first places of equals.

    A product of matrices only narrows: what it leaves is measured by differences, so that equal vectors tie."""
    k, size, found = min(k, len(held)), (held * held).sum(1), []
    step = max(1, CELLS_AT_ONCE // max(1, len(held)))
    for start in range(0, len(wanted), step):
        own = wanted[start : start + step]
        norm = (own * own).sum(1)
        d = norm[:, None] - 2 * own @ held.T + size[None]
        # above what rounding of the product can change
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-9 * (norm + size.max())
        row, at = np.nonzero(~(d > limit[:, None]))
        exact = np.sqrt(((own[row] - held[at]) ** 2).sum(1))
        order = np.lexsort((at, exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[first] + start, at[first], exact[first]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@dataclass
class VectorIndex:
    """``folder`` holds lists/list=N, and deleted ids; ids are strings."""

    spark: SparkSession
    folder: str
    centres: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> VectorIndex:
        """An index of ``vectors(id, embedding)``; a null id or vector is left out.  The sample is the vectors of smallest hash."""
        spark = vectors.sparkSession
        rows = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = rows.count()
        drawn = rows.withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(sample).select("embedding").toPandas()["embedding"]
        known = np.array(drawn.tolist(), float) if len(drawn) else np.zeros((0, 1))
        wanted = lists or max(1, min(MOST_LISTS, round(n / PER_LIST), len(known)))
        centres = fitted(known, wanted) if len(known) else np.zeros((1, 1))
        out = cls(spark, folder.rstrip("/"), centres, measured_probes(known, centres, recall) if len(known) > 1 else 1)
        out.add(rows)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{out.folder}/centres")
        spark.createDataFrame([(out.probes,)], "probes int").write.mode("overwrite").parquet(f"{out.folder}/settings")
        return out

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> VectorIndex:
        folder = folder.rstrip("/")
        centres = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()  # MOST_LISTS rows
        return cls(spark, folder, np.array([r.centre for r in centres], float), spark.read.parquet(f"{folder}/settings").first().probes)

    def _listed(self, rows: DataFrame, n: int) -> DataFrame:
        """id, embedding and the ``n`` nearest lists of each row."""
        centres, schema = self.centres, "id string, embedding array<double>, lists array<int>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, len(batch), 1_024):
                    part = batch.slice(i, 1_024)
                    vectors = _matrix(part.column("embedding"))
                    d = _distances(vectors, centres)
                    near = d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("embedding"), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "embedding", "lists"])

        return rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)

    def add(self, vectors: DataFrame) -> None:
        """More vectors, whose ids must be new or deleted before; they are in no list until they are all in theirs."""
        batch = uuid.uuid4().hex
        own = self._listed(vectors.where("id IS NOT NULL AND embedding IS NOT NULL"), 1).select("id", "embedding", F.lit(batch).alias("batch"), F.col("lists")[0].alias("list"))
        own.repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("append").partitionBy("list").parquet(f"{self.folder}/lists")

    def delete(self, ids: DataFrame) -> None:
        """The vectors of ``ids(id)`` that are there now go; an id may be added again later."""
        now = self.vectors().join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("id", "batch")
        now.write.mode("append").parquet(f"{self.folder}/deleted")

    def _deleted(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deleted")
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema("id string, batch string").parquet(f"{self.folder}/deleted") if there else None

    def vectors(self) -> DataFrame:
        """id, embedding, batch and list of all vectors."""
        rows = self.spark.read.schema("id string, embedding array<double>, batch string, list int").parquet(f"{self.folder}/lists")
        gone = self._deleted()
        return rows if gone is None else rows.join(gone, ["id", "batch"], "left_anti")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """query, id, distance and rank of the k nearest vectors of every row of ``queries(id, embedding)`` among the lists read.

        ``probes`` lists are read for each query (all of them: exact).  Only the lists that some query needs are read.
        """
        n = min(len(self.centres), probes or self.probes)
        asked = self._listed(queries, n).select(F.col("id").alias("query"), F.col("embedding").alias("q"), F.explode("lists").alias("list"))
        held = self.vectors().join(asked.select("list").distinct(), "list", "left_semi")
        # blocks of a list's vectors meet blocks of its queries: what a group holds does not grow with the tables
        most = held.groupBy("list").count().agg(F.max("count")).first()[0] or 1
        of_list, of_queries = max(1, -(-most // VECTORS_AT_ONCE)), max(1, -(-queries.count() // QUERIES_AT_ONCE))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        by = ("list", "vectors", "queries")
        left = held.select("list", "id", "embedding", block("id", of_list).alias("vectors"), every(of_queries).alias("queries"))
        right = asked.select("list", "query", "q", block("query", of_queries).alias("queries"), every(of_list).alias("vectors"))

        def run(mine: pa.Table, wanted: pa.Table) -> pa.Table:
            if not mine.num_rows or not wanted.num_rows:
                return pa.table({"query": pa.array([], pa.string()), "id": pa.array([], pa.string()), "distance": pa.array([], pa.float64())})
            mine = mine.sort_by("id")
            row, at, distance = nearest(_matrix(wanted.column("q")), _matrix(mine.column("embedding")), k)
            return pa.table({"query": wanted.column("query").take(pa.array(row)), "id": mine.column("id").take(pa.array(at)), "distance": distance})

        near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query string, id string, distance double")
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
        return near.withColumn("rank", place).where(F.col("rank") <= k)
