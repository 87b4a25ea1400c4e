"""The graph, corpus, vector and path views over the parquet tables, as DataFrames and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import spread
from graphloom.sources.session import table

_KINDS = [("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"), ("orders", "o", "o_orderkey", None)]


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, symbol_name, symbol_type, rel_path: every entity is a symbol."""
    parts = []
    for name, letter, key, label in _KINDS:
        own = F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))
        parts.append(table(spark, sf, name).select(own.alias("node_id"), (F.col(label) if label else F.concat(F.lit("Order"), F.col(key).cast("string"))).alias("symbol_name"), F.lit(name).alias("symbol_type"), F.concat(F.lit(f"src/{name}/"), (F.col(key) % 10).cast("string"), F.lit("/"), F.col(key).cast("string"), F.lit(".py")).alias("rel_path")))
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """source_id, target_id, rel_type: a bag of typed edges."""
    link = lambda df, a, x, b, y, rel: df.select(F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("source_id"), F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("target_id"), F.lit(rel).alias("rel_type"))
    items = table(spark, sf, "lineitem")
    n = items.count()
    pairs = lambda a, b: spread(items.select(a, b), a, n).distinct()
    parts = [
        link(table(spark, sf, "nation"), "n", "n_nationkey", "r", "n_regionkey", "contains"),
        link(table(spark, sf, "customer"), "c", "c_custkey", "n", "c_nationkey", "references"),
        link(table(spark, sf, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "references"),
        link(table(spark, sf, "orders"), "o", "o_orderkey", "c", "o_custkey", "calls"),
        link(pairs("l_orderkey", "l_partkey"), "o", "l_orderkey", "p", "l_partkey", "composition"),
        link(pairs("l_partkey", "l_suppkey"), "p", "l_partkey", "s", "l_suppkey", "composition"),
    ]
    return reduce(DataFrame.unionByName, parts)


GRAPH_SQL = "nodes AS (" + " UNION ALL ".join(
    f"SELECT '{a}:' || {k} AS node_id, {n or f"'Order' || {k}"} AS symbol_name, '{t}' AS symbol_type, 'src/{t}/' || ({k} % 10) || '/' || {k} || '.py' AS rel_path FROM {t}" for t, a, k, n in _KINDS
) + """), edges AS (
  SELECT 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id, 'contains' AS rel_type FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'references' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'references' FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'calls' FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'composition' FROM lineitem
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'composition' FROM lineitem
)"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text, language, path."""
    return table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("language"), "source", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))


CORPUS_SQL = "corpus AS (SELECT doc_id, text, lang AS language, source, source || '/' || lang || '/' || doc_id AS path FROM documents)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
