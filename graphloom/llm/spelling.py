"""Words that are one edit apart, and the common form that a rare spelling stands for.

Two words are near if one code point inserted, deleted or replaced makes one the other.  Every word has a bit mask of
the parities of its letters (letters share ``BITS`` bits by code point); an edit flips at most two bits, so of three
bands of the mask at least one is equal, and at least one of the halves that an edit leaves whole (the first or last
code points, half as many as the shorter word has) is equal too.  Words meet by length of the shorter, band and half;
masks, then the words themselves, are verified, and a pair counts where it meets first.  Joining by band and length
alone would make 12 billion candidates of half a million words, with the halves it makes 0.2 billion.

Edge cases: null words and counts are left out; words that repeat count as one with their counts summed; ties of counts
go to the word that is first by code points; an empty table gives an empty result.  Very long words are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.cluster import tidied, written
from graphloom.llm.columns import ascii_lower

#: A multiple of the three bands; band ``i`` has the bits that leave ``i`` when divided by three.
BITS, BANDS = 60, 3
BAND_MASKS = [sum(1 << b for b in range(i, BITS, BANDS)) for i in range(BANDS)]
#: A form is at least so many times as frequent.
RATIO = 5

RUN = "[A-Za-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT = 6, 5
#: One run of this many (by the hash of document and run) loses a code point.
SLIP = 199


def run_counts(documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """word and n: runs of letters of all texts, A-Z lower-cased, with the slips of the contract.

    A null text has no runs; a null doc_id is an empty string in the hash.
    """
    # a run of fewer letters gives no word long enough, so only longer ones are cut out
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{min_chars},}}+"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run")).withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run")))
    place = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def parity_mask(word: F.Column) -> F.Column:
    """A bit for every letter (code points that leave the same remainder share one), set if the letter is there an odd number of times."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two near words once, of distinct ``words`` (word, n)."""
    sized = words.select("word", "n", F.length("word").alias("size"), parity_mask(F.col("word")).alias("mask"))
    # a word meets those of its own size and one longer (it is the shorter), and those one shorter (it is the longer)
    placed = sized.withColumn("shorter", F.explode(F.array(F.col("size"), F.col("size") - 1))).withColumn("half", F.expr("shorter div 2").cast("int"))
    half = F.array(F.substring("word", F.lit(1), F.col("half")), F.substring("word", F.col("size") - F.col("half") + 1, F.col("half")))
    halves = placed.select("word", "n", "size", "mask", "shorter", F.posexplode(half).alias("side", "part"))
    bands = F.array(*(F.col("mask").bitwiseAND(F.lit(m)) for m in BAND_MASKS))
    keyed = halves.select("word", "n", "size", "mask", "shorter", "side", "part", F.posexplode(bands).alias("band", "bits"))
    keys = ["shorter", "side", "part", "band", "bits"]
    a = keyed.where("size = shorter").withColumnsRenamed({"word": "a", "n": "n_a", "mask": "mask_a"}).drop("size")
    b = keyed.withColumnsRenamed({"word": "b", "n": "n_b", "mask": "mask_b", "size": "size_b"})
    # every word has twelve keys, which Spark's estimate of a side leaves out: it would send all of them through the driver
    met = a.join(b.hint("merge"), keys).where("(size_b > shorter OR a < b) AND bit_count(mask_a ^ mask_b) <= 2")
    # the first band and half at which they meet; at the others the pair has been seen
    first_band = F.expr(" AND ".join(f"(band <= {i} OR (mask_a & {m}L) <> (mask_b & {m}L))" for i, m in enumerate(BAND_MASKS[:-1])))
    first_half = F.expr("side = 0 OR left(a, shorter div 2) <> left(b, shorter div 2)")
    near = F.levenshtein("a", "b", 1) == 1
    return met.where(first_band).where(first_half).where(near).select("a", "n_a", "b", "n_b")


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, n_near and root of every word of ``words`` (word, n)."""

    def make() -> DataFrame:
        counted = written(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
        pairs = near_pairs(counted)
        ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))).alias("w")).select("w.*")
        best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
        joined = counted.join(best, "word", "left")
        is_form = -F.col("best.less") >= F.col("n") * ratio
        formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
        formed = written(formed, "forms")
        ends = _ends(formed).withColumnsRenamed({"word": "form", "end": "_end"})
        return formed.join(ends, "form", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("_end", "form", "word").alias("root"))

    return tidied(words.sparkSession, "spellings", make)


def _ends(formed: DataFrame) -> DataFrame:
    """word, end: the last form of every word that is a form of others and has one itself.

    Counts grow along a chain by the ratio at least, so it has few steps, and rounds double what they cover.
    """
    forms = formed.where("form IS NOT NULL").select(F.col("form").alias("word")).distinct()
    ends = written(formed.join(forms, "word", "left_semi").where("form IS NOT NULL").select("word", F.col("form").alias("end")), "ends")
    while True:
        onward = ends.select(F.col("word").alias("end"), F.col("end").alias("next"))
        ends = written(ends.join(onward, "end", "left").select("word", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved")), "ends")
        moved = not ends.where("moved").isEmpty()
        ends = ends.drop("moved")
        if not moved:
            return ends


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_forms(run_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


#: The hash by its polynomial, a byte at a time; near words by the rests of words without one code point.
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc || ':' || run) + 1), lambda i: CAST('0x' || substr(hex(doc || ':' || run), 2 * i - 1, 2) AS BIGINT))),
         lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]))) AS h
  FROM counted, bits
), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), rests AS (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS place FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS n_near FROM rests a JOIN rests b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, near, n_near, count(*) OVER (PARTITION BY word) AS found, row_number() OVER (PARTITION BY word ORDER BY n_near DESC, near) AS place FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(found, 0) AS n_near, CASE WHEN b.n_near >= 5 * w.n THEN near END AS form, CASE WHEN b.n_near >= 5 * w.n THEN b.n_near END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.place = 1
), chain AS (
  SELECT word, word AS last, 0 AS step FROM forms
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, form, c.last AS root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(last, step) AS last FROM chain GROUP BY word) c ON f.word = c.word
"""
