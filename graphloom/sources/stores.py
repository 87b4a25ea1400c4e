"""Tables of a graph in a folder: nodes, edges, vectors, facts, registries, each replaced whole so that nothing stale stays.

A table is a folder of versions and a folder of their names, numbered; a new version is written beside the old, then named,
so readers always see a whole table and a failed write changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.sources.shared import removed, written

NODE_KEY, EDGE_ENDS = "node_id", ("source_id", "target_id")
#: Texts that are embedded at once.
EMBEDDED_AT_ONCE = 64


def flagged(nodes: DataFrame) -> DataFrame:
    """Types in small letters, and the flags that follow from type and path, whatever the given ones say."""
    kind = F.lower(F.coalesce("symbol_type", F.lit("")))
    rows = nodes.withColumn("symbol_type", kind)
    rows = rows.withColumn("is_architectural", S.is_architectural_type(kind)).withColumn("is_doc", S.is_doc_type(kind))
    return rows.withColumn("is_test", S.is_test_path(F.coalesce("rel_path", F.lit(""))))


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the last by ``order``; rows without a key go."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.where(F.col(key).isNotNull()).withColumn("_r", place).where("_r = 1").drop("_r", order)


def merged(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """The old rows with the new ones in their place; columns that one side lacks are null."""
    new = last_written(new.withColumn("_order", F.monotonically_increasing_id()), key, "_order")
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def embedding_attempts(nodes: DataFrame, embed: Callable[[list[str]], list[list[float]]], most: int = EMBEDDED_AT_ONCE) -> DataFrame:
    """node_id, embedding, error of every node with a text that is not blank: one of the two is null.

    Texts go to ``embed`` by ``most``.  A batch that fails, or gives another number of vectors, is tried again text by text,
    so that one bad text costs no other its vector; white and control characters count as spaces.
    """
    text = F.coalesce(F.when(F.trim("source_text") != "", F.col("source_text")), F.col("docstring"))
    rows = nodes.select(NODE_KEY, F.regexp_replace(text, r"[\p{Z}\p{C}]", " ").alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    schema = pa.schema([(NODE_KEY, pa.string()), ("embedding", pa.list_(pa.float32())), ("error", pa.string())])

    def tried(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            got = embed(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return [(v, None) for v in got]
        except Exception as e:  # noqa: BLE001 - whatever the model raises is kept with the row
            return [x for t in texts for x in tried([t])] if len(texts) > 1 else [(None, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(NODE_KEY).to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(ids), most):
                vectors, errors = zip(*tried(texts[i : i + most]), strict=True)
                yield pa.RecordBatch.from_pydict({NODE_KEY: ids[i : i + most], "embedding": vectors, "error": errors}, schema=schema)

    return rows.mapInArrow(run, f"{NODE_KEY} string, embedding array<float>, error string")


def embedded(nodes: DataFrame, embed: Callable[[list[str]], list[list[float]]], most: int = EMBEDDED_AT_ONCE) -> DataFrame:
    """node_id, embedding of the nodes whose text could be embedded; ``GraphStore.embed`` keeps the others with their errors."""
    return embedding_attempts(nodes, embed, most).where("error IS NULL").drop("error")


class GraphStore:
    """A graph's tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self, table: str) -> list[tuple[int, str]]:
        """Number and name of the versions that have been named, the current one last."""
        fs, where = self._fs(f"{self.folder}/{table}/_names")
        if not fs.exists(where):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(where))
        return sorted((int(n), v) for n, _, v in (name.partition("-") for name in names))

    def _current(self, table: str) -> str | None:
        known = self._versions(table)
        return known[-1][1] if known else None

    def read(self, table: str) -> DataFrame | None:
        """The current version, or None."""
        version = self._current(table)
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{table}/{version}")

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """A new version, then its name; the version before stays for its readers, older ones go.

        A name is an empty file of the version's number and id: it is there or not, so a crash leaves the table as it was.
        If another writer has named a version meanwhile, this one fails rather than lose what that one wrote.
        """
        before, new = self._versions(table), uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{table}/{new}")
        if self._versions(table) != before:
            removed(self.spark, f"{self.folder}/{table}/{new}")
            raise RuntimeError(f"{table} was written by another while this was made; read it again")
        number = before[-1][0] + 1 if before else 0
        fs, name = self._fs(f"{self.folder}/{table}/_names/{number:012d}-{new}")
        fs.create(name, False).close()
        if sum(n == number for n, _ in self._versions(table)) > 1:  # of two at once at least one sees the other
            fs.delete(name, False)
            removed(self.spark, f"{self.folder}/{table}/{new}")
            raise RuntimeError(f"{table} was written by another while this was named; read it again")
        for n, old in before[:-1]:
            removed(self.spark, f"{self.folder}/{table}/_names/{n:012d}-{old}")
            removed(self.spark, f"{self.folder}/{table}/{old}")
        return self.read(table)

    def upsert_nodes(self, nodes: DataFrame) -> DataFrame:
        return self.write("nodes", merged(self.read("nodes"), flagged(nodes), NODE_KEY))

    def append_edges(self, edges: DataFrame) -> DataFrame:
        old = self.read("edges")
        return self.write("edges", edges if old is None else old.unionByName(edges, allowMissingColumns=True))

    def replace(self, nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
        """A new snapshot: nodes that are not in it go, with their edges and vectors."""
        old = self.read("nodes")
        gone = 0 if old is None else old.join(nodes.select(NODE_KEY), NODE_KEY, "left_anti").count()
        kept = self.write("nodes", flagged(last_written(nodes.withColumn("_order", F.monotonically_increasing_id()), NODE_KEY, "_order")))
        ids = kept.select(NODE_KEY)
        own = edges
        for end in EDGE_ENDS:
            own = own.join(ids.withColumnRenamed(NODE_KEY, end), end, "left_semi")
        self.write("edges", own.select(*edges.columns))
        if (vectors := self.read("vectors")) is not None:
            self.write("vectors", vectors.join(ids, NODE_KEY, "left_semi"))
        return {"nodes": kept.count(), "purged": gone}

    def upsert_vectors(self, vectors: DataFrame) -> DataFrame:
        return self.write("vectors", merged(self.read("vectors"), vectors, NODE_KEY))

    def embed(self, embed: Callable[[list[str]], list[list[float]]], most: int = EMBEDDED_AT_ONCE) -> dict[str, int]:
        """Vectors of all nodes with a text; nodes that have none at the end are in the table ``failures`` with their errors."""
        tried = written(embedding_attempts(self.read("nodes"), embed, most), "embedded")
        self.upsert_vectors(tried.where("error IS NULL").drop("error"))
        self.write("failures", tried.where("error IS NOT NULL").select(NODE_KEY, "error"))
        return {"vectors": tried.where("error IS NULL").count(), "failures": tried.where("error IS NOT NULL").count()}

    def vectors_of(self, ids: DataFrame) -> DataFrame:
        return self.read("vectors").join(ids.select(NODE_KEY), NODE_KEY, "left_semi")

    def set_clusters(self, assigned: DataFrame) -> DataFrame:
        """macro_cluster and micro_cluster of the nodes in ``assigned(node_id, macro_cluster, micro_cluster)``; others keep theirs."""
        nodes = self.read("nodes")
        for c in ("macro_cluster", "micro_cluster"):
            nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast("int"))
        new = assigned.select(NODE_KEY, F.col("macro_cluster").alias("_macro"), F.col("micro_cluster").alias("_micro"), F.lit(True).alias("_set"))
        rows = nodes.join(new, NODE_KEY, "left")
        for c, n in (("macro_cluster", "_macro"), ("micro_cluster", "_micro")):
            rows = rows.withColumn(c, F.when(F.col("_set"), F.col(n)).otherwise(F.col(c)))
        return self.write("nodes", rows.drop("_macro", "_micro", "_set"))

    def set_hubs(self, hubs: DataFrame) -> DataFrame:
        """is_hub and hub_assignment of the nodes in ``hubs(node_id, is_hub, assignment)``; others keep theirs."""
        nodes = self.read("nodes")
        for c, kind in (("is_hub", "boolean"), ("hub_assignment", "string")):
            nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast(kind))
        rows = nodes.join(hubs.select(NODE_KEY, F.col("is_hub").alias("_hub"), F.col("assignment").alias("_to")), NODE_KEY, "left")
        rows = rows.withColumn("hub_assignment", F.when(F.col("_hub").isNotNull(), F.col("_to")).otherwise(F.col("hub_assignment")))
        return self.write("nodes", rows.withColumn("is_hub", F.coalesce("_hub", "is_hub", F.lit(False))).drop("_hub", "_to"))

    def set_weights(self, weights: DataFrame) -> DataFrame:
        """weight of the edges in ``weights(edge_id, weight)``; others keep theirs."""
        return self.write("edges", self.read("edges").join(weights.select("edge_id", F.col("weight").alias("_w")), "edge_id", "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_w"))

    def put(self, key: str, value: object) -> None:
        """A fact, as JSON."""
        row = self.spark.createDataFrame([(key, json.dumps(value, sort_keys=True))], "key string, value string")
        self.write("facts", merged(self.read("facts"), row, "key"))

    def get(self, key: str, other: object = None) -> object:
        facts = self.read("facts")
        row = None if facts is None else facts.where(F.col("key") == key).first()
        return other if row is None else json.loads(row.value)

    def export(self, path: str) -> None:
        """Nodes and edges as lines of JSON."""
        for table in ("nodes", "edges"):
            self.read(table).write.mode("overwrite").json(f"{path}/{table}")

    def load(self, path: str) -> dict[str, int]:
        """What ``export`` wrote, as a snapshot."""
        return self.replace(self.spark.read.json(f"{path}/nodes"), self.spark.read.json(f"{path}/edges"))


class Registry:
    """Named records (of generated sites, analyses, caches) in a store: put, list, remove, find by identity."""

    def __init__(self, store: GraphStore, name: str = "registry"):
        self.store, self.name = store, name

    def put(self, key: str, record: dict) -> None:
        row = self.store.spark.createDataFrame([(key, json.dumps(record, sort_keys=True))], "key string, record string").withColumn("at", F.current_timestamp())
        self.store.write(self.name, merged(self.store.read(self.name), row, "key"))

    def list(self) -> DataFrame:
        rows = self.store.read(self.name)
        return rows if rows is not None else self.store.spark.createDataFrame([], "key string, record string, at timestamp")

    def remove(self, key: str) -> bool:
        """Whether there was such a record."""
        rows = self.list()
        if not rows.where(F.col("key") == key).limit(1).count():
            return False
        self.store.write(self.name, rows.where(F.col("key") != key))
        return True

    def find(self, identity: str) -> dict | None:
        """The record of a repository: by its whole identity (path:branch:commit), by path and branch, or the latest of the path."""
        parts = identity.split(":")
        rows = self.list()
        for wanted in dict.fromkeys(":".join(parts[:n]) for n in (len(parts), 2, 1)):
            own = rows.where((F.col("key") == wanted) | F.col("key").startswith(wanted + ":"))
            row = own.orderBy(F.col("key") != wanted, F.desc("at"), "key").first()
            if row is not None:
                return json.loads(row.record)
        return None
