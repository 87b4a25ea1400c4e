"""Full-text search, vector search and fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def space_tokens(text: Column) -> Column:
    """Tokens between white space; case kept."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def idf(docs: DataFrame, terms: list[str]) -> DataFrame:
    """term, df and ln(N / (1 + df))."""
    toks = docs.select(F.array_distinct(word_tokens(F.col("text"))).alias("t"))
    stats = toks.agg(F.count("*").alias("n"), *(F.sum(F.array_contains("t", x).cast("int")).alias(f"d{i}") for i, x in enumerate(terms)))
    rows = stats.select("n", F.explode(F.array(*(F.struct(F.lit(x).alias("term"), F.col(f"d{i}").alias("df")) for i, x in enumerate(terms)))).alias("r"))
    return rows.select("r.term", "r.df", F.log(F.col("n") / (1 + F.col("r.df"))).alias("idf"))


def _dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)")


def knn(vectors: DataFrame, to: DataFrame, k: int, metric: str = "l2", by: str = "vec_id") -> DataFrame:
    """The k nearest to the one vector ``to(q)``: id, distance; a broadcast of one row, then a top-k that combines in each task."""
    both = vectors.crossJoin(F.broadcast(to.limit(1)))
    if metric == "l2":
        d = F.sqrt(F.expr("aggregate(zip_with(embedding, q, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"))
    else:
        d = 1 - _dot("embedding", "q") / (F.sqrt(_dot("embedding", "embedding")) * F.sqrt(_dot("q", "q")))
    return both.withColumn("distance", d).drop("q", "embedding").orderBy("distance", by).limit(k)


def ranked_list(hits: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """key and its 1-based rank; hits are a top-k list, so one task ranks them."""
    return hits.select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rrf(lists: list[tuple[DataFrame, float]], key: str, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (constant + rank) over the lists."""
    rows = None
    for hits, weight in lists:
        own = hits.select(key, (F.lit(weight) / (constant + F.col("rank"))).alias("s"))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy(key).agg(F.sum("s").alias("score"), F.count("*").alias("lists"))


def cutoff(hits: DataFrame, threshold: float, k: int) -> DataFrame:
    """Hits with score at least max * (1 - threshold), the k best."""
    best = hits.agg(F.max("score").alias("_m"))
    return hits.crossJoin(F.broadcast(best)).where(F.col("score") >= F.col("_m") * (1 - threshold)).drop("_m").orderBy(F.desc("score"), "doc_id").limit(k)


def keywords(question: str, stop: frozenset[str] = frozenset("a an and are as at be by for from how i in is it of on or that the this to what where which who why with".split())) -> list[str]:
    """Words of a question without stop words, identifiers also by their parts, in order and once."""
    out: list[str] = []
    for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]+", question):
        parts = re.sub("([a-z0-9])([A-Z])", r"\1 \2", w).replace("_", " ").split()
        for x in [w, *(parts if len(parts) > 1 else [])]:
            if x.lower() not in stop and x.lower() not in out:
                out.append(x.lower())
    return out
