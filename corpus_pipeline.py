"""From raw documents to token files: quality rules, near-duplicate removal, decontamination, mixing, tokens.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of documents, whatever further ones they are (a stage works
on columns of its own names).  Rows with a null doc_id cannot be told apart: they stay until a rule on their own text
rejects them.  Null, empty and blank texts have no words, so the quality rules reject them; very long texts are treated
whole; of rows that repeat a doc_id and its text one stays at the second stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.cluster import written
from graphloom.llm.decontaminate import leaks
from graphloom.llm.mixing import mixed
from graphloom.llm.ngram_join import BROADCAST_IDS, ngram_jaccard_join
from graphloom.llm.quality import fit_quality, quality_rules
from graphloom.llm.token_files import token_files


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """The stage on columns whose names cannot clash with its own; all come back as they were."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = ("doc_id", "text", "source")
        inner = [c if c in used else f"_extra{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*inner).toDF(*docs.columns)

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less those whose doc_id is in ids(doc_id): a broadcast of a counted size, or a shuffled join beyond it."""
    ids = written(ids.where("doc_id IS NOT NULL").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


@_apart
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, model, carry=tuple(docs.columns)).where("kept").select(*docs.columns)


@_apart
def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; of rows that repeat it, one."""
    found = ngram_jaccard_join(docs, count_links=False)  # a written table
    kept = _without(docs, found.where("component_id <> doc_id").select("doc_id"))
    repeated = written(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.limit(1).count():
        return _without(kept, repeated).unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept


@_apart
def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return _without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


@_apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    drawn = mixed(docs, carry=rest).where("copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row per document drawn."""
    return token_files(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_first),
    ("benchmark decontamination", keep_unleaked),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The stages' classifier, edit distances and tokenizer cannot be said in SQL; tests/llm/test_pipeline.py compares every
#: stage, and run(), with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
