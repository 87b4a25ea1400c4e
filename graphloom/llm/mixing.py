"""Mixing sources to target weights by systematic sampling.

Edge cases: a null text has size 0; the null source is a source of its own, last in order; repeated rows are
documents of their own; of rows with one source, size and doc_id (null ones, say) the order is that of hashes of their
texts and carried columns, so that reruns agree; a source of size 0 has target 0 and gives nothing; an empty table
gives an empty mix; very long texts count whole; a carried column that bears the name of an output comes back with
underscores before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.cluster import free_names
from graphloom.llm.ordered import ranked

WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own words, no document more than this many copies.
MAX_REPEATS = 3
SEED = "mix-1"


def text_size() -> F.Column:
    """Words of the text: places where a word starts."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size and target, a row per source.

    Water-filling in closed form: sources whose cap is lowest for their weight are capped first; the level of
    the others is what is left over their weights.  One row per source goes through one task here.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = total.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    listed = listed.withColumn("cap", F.col("source_size") * float(max_repeats))
    ratio = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    up_to = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    listed = listed.withColumn("cap_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(up_to), F.lit(0.0)))
    listed = listed.withColumn("level", (F.sum("source_size").over(everything) - F.col("cap_before")) / (F.sum("w").over(everything) - F.col("w_before")))
    # the level that holds is the first at which the next source in order is not capped any more
    listed = listed.withColumn("final", F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct("cap_before", "level"))).over(everything)["level"])
    return listed.select("source", "source_size", F.when(F.col("cap") < F.col("w") * F.col("final"), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def mixed(documents: DataFrame, carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document.

    Within a source every document expects target / source_size copies.  Documents stand in order of size, so
    that neighbours are interchangeable and the words taken stay near the target; the prefix sum of expected
    copies, moved by one random offset of the source, gives a document a copy for each integer it crosses.
    """
    own = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    names = [f"_c{i}" for i in range(len(carry))]
    carried = [F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)]
    sized = documents.select("doc_id", "source", *carried, text_size().alias("size"), F.xxhash64("text").alias("_text"))
    # a map has no hash
    plain = [F.to_json(F.struct(n)) if "map<" in k else F.col(n) for n, k in sized.dtypes if n in names]
    sized = sized.withColumn("_tie", F.xxhash64("_text", *plain)).drop("_text")
    placed = ranked(sized, "source", ["size", "doc_id", "_tie"], name="mix")
    targets = source_targets(placed.select("source", "size"), weights, max_repeats).withColumnRenamed("source", "_source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # a row per source: small, and joined as a hash table or, if very many, by a shuffle, as the planner sees fit
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("u") + (F.col("rank") + 1) * F.col("rate")) - F.floor(F.col("u") + F.col("rank") * F.col("rate"))
    out = joined.withColumn("u", offset).withColumn("rate", rate).withColumn("copies", F.least(F.lit(max_repeats), crossed).cast("long"))
    out = out.select("doc_id", "source", *names, *own[2:6], (F.col("copies") * F.col("size")).alias("taken"))
    return out.toDF("doc_id", "source", *free_names(carry, own), *own[2:])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), total AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), listed AS (
  SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM total
), stepped AS (
  SELECT *, coalesce(sum(cap) OVER up_to, 0) AS cap_before, coalesce(sum(w) OVER up_to, 0) AS w_before FROM listed
  WINDOW up_to AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - cap_before) / (sum(w) OVER () - w_before) AS level FROM stepped
), final AS (
  SELECT level AS final FROM levels WHERE cap >= w * level ORDER BY cap_before LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN cap < w * final THEN cap ELSE w * final END AS target FROM levels, final
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS rank,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(s.source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(least(3, floor(u + (rank + 1) * rate) - floor(u + rank * rate)) AS BIGINT) * size AS taken FROM placed
"""
