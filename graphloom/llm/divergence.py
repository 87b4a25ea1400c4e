"""How the sources of a language differ in the terms they use.

Terms of every text are counted by language and source; a language keeps the terms of enough of its documents.  Every
group (a language's source) and every language gives each kept term a smoothed share in whole parts of ``SCALE``; zeros
are filled in by joining the groups of a language with its kept terms.  Groups are compared with one another by the sum
of the differences of their shares, and with their language by the terms that they use most beyond it.

All arithmetic is exact: counts too large for 64 bits once scaled are divided as decimals.

Edge cases: null text, lang and source are empty strings; every row is a document, repeated ones too; a group without
terms, and one whose language keeps none, is compared as any other (all values are 0 where no term is kept); ties are
in order of the item's bytes; an empty table gives an empty result; very long texts count whole; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.cluster import tidied, written
from graphloom.llm.columns import ascii_lower

#: What stands between terms, which are runs of ASCII letters and of anything beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Up to so many groups (of less than a kilobyte each) are broadcast; more are joined in SALTS parts of each language.
BROADCAST_GROUPS = 10_000
SALTS = 512


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    group = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    # cut where no term is: several times cheaper than a match object for each term; the texts' ends may give empty ones
    terms = F.sort_array(F.split(ascii_lower(F.coalesce("text", F.lit(""))), BETWEEN))
    starts = F.expr("filter(sequence(0, size(terms) - 1), i -> i = 0 OR terms[i] <> terms[i - 1])")
    # a document's equal terms stand together and are counted there, so that each goes on once
    runs = F.expr("transform(starts, (at, k) -> struct(terms[at] AS term, coalesce(get(starts, k + 1), size(terms)) - at AS n))")
    found = documents.select(*group, terms.alias("terms")).select("*", starts.alias("starts")).select("lang", "source", F.explode(runs).alias("run"))
    return found.where("run.term <> ''").groupBy("lang", "source", "run.term").agg(F.sum("run.n").alias("n"), F.count("*").alias("docs"))


def share(count: str, total: str, kept: str, prior: int = PRIOR) -> F.Column:
    """1 + floor(SCALE * (count + prior) / (total + prior * kept)), exactly."""
    below = f"({total} + {prior}L * {kept})"
    plain = f"{SCALE}L * ({count} + {prior}L) div {below}"
    wide = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {prior}L AS DECIMAL(20, 0)) div CAST({below} AS DECIMAL(20, 0))"
    return F.expr(f"1L + CASE WHEN {count} < {2**63 // SCALE - prior - 1}L THEN {plain} ELSE {wide} END")


def _dense(kept: DataFrame, groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, term, n, and the parts for sums of every kept term in every group of its language."""
    if groups.count() <= BROADCAST_GROUPS:
        every = kept.join(F.broadcast(groups), "lang")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        every = kept.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "salt"]).drop("salt")
    return every.join(counts, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def source_divergence(documents: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""

    def make() -> DataFrame:
        counts = written(term_counts(documents), "terms")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
        kept = written(kept, "kept-terms")
        counts = written(counts.drop("docs").join(kept, ["lang", "term"], "left_semi"), "kept-counts")
        named = documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
        by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = named.join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").fillna(0, ["v", "total_lang", "total"])
        groups = written(groups, "groups")
        dense = _dense(kept, groups.where("v > 0"), counts)
        dense = dense.select("lang", "source", "term", "n", share("n", "total", "v", prior).alias("p"), share("n_lang", "total_lang", "v", prior).alias("q"))
        dense = written(dense, "shares")
        return _pairs(dense, groups).unionByName(_terms(dense, top_terms))

    return tidied(documents.sparkSession, "divergence", make)


def _pairs(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """Every source of a language against every other; each pair is summed once."""
    one = dense.select("lang", "term", "source", "p")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    named = groups.select("lang", "source")
    pairs = named.join(named.withColumnRenamed("source", "item"), "lang").where("source < item").join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    both = pairs.withColumn("way", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))).select("lang", "way.source", "way.item", "value")
    return _ranked(both, "pair")


def _terms(dense: DataFrame, top_terms: int) -> DataFrame:
    beyond = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(beyond, "term").where(F.col("rank") <= top_terms)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), found AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY f.lang, f.source, f.term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n_lang) OVER (PARTITION BY lang, source) AS total_lang, count(*) OVER (PARTITION BY lang, source) AS v FROM dense
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (n_lang + 5)) // (total_lang + 5 * v)::HUGEINT AS q FROM summed
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
