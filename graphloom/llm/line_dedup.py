"""Lines that many documents share, dropped from all but one of them.

Every line gets a key: what is left of it when white space at both ends is cut and A-Z lower-cased.  Keys are hashed to
128 bits; a key of enough code points that enough documents hold loses its lines in all documents but that of the
largest doc_id.  The hashes of lines are counted and joined, never the lines themselves; positions to drop come back to
the texts, which are shuffled once.

Edge cases: null and empty texts are one empty line; rows that repeat a doc_id are one document (if their texts differ,
each is cut on its own, and all of them keep their lines where theirs is the largest doc_id); rows without doc_id are
together one document that ranks below all others; an empty table gives an empty result; very long texts and lines are
treated whole; a carried column that bears the name of an output comes back with underscores before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.cluster import free_names, tidied, written
from graphloom.llm.columns import ascii_lower

MIN_CHARS = 20
MIN_DOCS = 3
#: White space that does not count at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Keys with more than one in this many of all lines are joined by a broadcast, so that there are at most so many of
#: them (of about 100 bytes each) and no other key fills a task.
HOT_SHARE = 50_000


def _lines() -> F.Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _row() -> F.Column:
    """With doc_id it tells texts apart; rows equal in both lose the same lines."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_keys(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row, at and the two halves of the key's hash, of every line whose key is long enough."""
    lines = documents.select("doc_id", _row().alias("row"), F.posexplode(_lines()).alias("at", "line"))
    keyed = lines.select("doc_id", "row", "at", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))


def repeated_keys(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """k1, k2, lines and the last doc_id of the keys that enough documents hold."""
    by_document = keys.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("lines"))
    by_key = by_document.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("doc_id").alias("last"))
    return by_key.where(F.col("docs") >= min_docs).select("k1", "k2", "lines", "last")


def drop_repeated_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without the lines dropped, n_lines (before), n_dropped and the carried columns of every row."""
    own = ["doc_id", "text", "n_lines", "n_dropped"]
    inner = [f"_c{i}" for i in range(len(carry))]
    docs = documents.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, inner, strict=True)))

    def make() -> DataFrame:
        keys = written(line_keys(docs, min_chars), "line-keys")
        repeated = written(repeated_keys(keys, min_docs), "repeated-lines")
        hot = F.col("lines") > max(1, keys.count() // HOT_SHARE)
        found = keys.join(F.broadcast(repeated.where(hot)), ["k1", "k2"]).unionByName(keys.join(repeated.where(~hot), ["k1", "k2"]))
        dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "row").agg(F.collect_set("at").alias("dropped"))
        return _without(docs, dropped, inner)

    names = free_names(carry, own)
    return tidied(documents.sparkSession, "lines-kept", make).toDF(*own, *names)


def _without(docs: DataFrame, dropped: DataFrame, inner: list[str]) -> DataFrame:
    dropped = dropped.withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    joined = docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_doc"]) & (_row() == F.col("_row")), "left")
    cut = joined.withColumns({"_lines": _lines(), "dropped": F.coalesce("dropped", F.array().cast("array<int>"))}).withColumn("n_lines", F.size("_lines").cast("long"))
    # places that stay, found by a hash of the places that go: linear in the lines of a text
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("dropped"))
    text = F.when(F.size("dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.col("_lines")[i]), "\n"))
    return cut.select("doc_id", text.alias("text"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), *inner)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
