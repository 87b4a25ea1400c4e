"""Texts cut into chunks: Markdown by its headings, each section with the path of headings above it; other texts by lines.

A text's lines are numbered, and what a reader of the text would keep in mind (inside a fence or not, the last heading of
each level) is a window over them.  The lines of one text stand together; texts are spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S

#: Texts of so many characters stay whole; levels of headings that cut; lines of a chunk where there are no headings.
WHOLE, LEVELS, TEXT_LINES, MARKDOWN_LINES = 17_000, 4, 30, 50


def _deepest(headers: Column) -> Column:
    return F.get(F.filter(F.array(*(headers[f"h{i}"] for i in range(LEVELS, 0, -1))), lambda h: h.isNotNull()), F.lit(0))


def chunked(docs: DataFrame, key: str, path: str, kind: str, text: str = "text", whole: int = WHOLE) -> DataFrame:
    """key, section_order, section_type, summary, headers (h1 to h4), content, start_line, end_line of every text.

    ``kind`` is a column with 'markdown' or another type of document.  A text of up to ``whole`` characters is one chunk named by
    its file.  Longer Markdown is cut at headings of levels 1 to 4 outside fences; the heading stays in its section, whose
    name is the deepest heading above it, and the text ahead of the first heading is a section of its own.  Longer Markdown
    without headings goes by 50 lines, other long texts by 30; chunks without a word are left out there.  Null texts are empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(kind).alias("kind"), body.alias("body"))
    none = F.struct(*(F.lit(None).cast("string").alias(f"h{i}") for i in range(1, LEVELS + 1)))
    short = base.where(F.length("body") <= whole)
    one = short.select("key", F.lit(0).alias("section_order"), F.concat("kind", F.lit("_document")).alias("section_type"), S.file_stem(F.col("path")).alias("summary"), none.alias("headers"), F.col("body").alias("content"), F.lit(1).alias("start_line"), F.size(F.split("body", "\n", -1)).alias("end_line"))

    lines = base.where(F.length("body") > whole).select("key", "kind", F.posexplode(F.split("body", "\n", -1)).alias("at", "line"))
    order = Window.partitionBy("key").orderBy("at")
    mark = F.regexp_extract("line", rf"^(#{{1,{LEVELS}}})(?:[ \t]|$)", 1)
    fence = F.when((F.col("kind") == "markdown") & F.col("line").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)
    read = lines.withColumn("fence", fence).withColumn("fenced", (F.sum("fence").over(order) - F.col("fence")) % 2 == 1)
    read = read.withColumn("level", F.when((F.col("kind") == "markdown") & ~F.col("fenced") & (F.col("fence") == 0), F.length(mark)).otherwise(0))
    read = read.withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#+\s*|\s*#*\s*$", ""))))
    read = read.withColumn("headings", F.max("level").over(Window.partitionBy("key"))).withColumn("section", F.sum(F.signum("level")).over(order).cast("int"))
    step = F.when(F.col("kind") == "markdown", MARKDOWN_LINES).otherwise(TEXT_LINES)
    read = read.withColumn("part", F.when(F.col("headings") > 0, F.col("section")).otherwise(F.floor(F.col("at") / step)).cast("int"))
    # the last heading of a level holds until one above it comes
    for i in range(1, LEVELS + 1):
        read = read.withColumn(f"p{i}", F.last(F.when(F.col("level") == i, F.struct(F.col("at").alias("at"), F.col("title").alias("title"))), True).over(order))
    ahead = lambda i: reduce(Column.__and__, (F.coalesce(F.col(f"p{i}.at") > F.col(f"p{j}.at"), F.lit(True)) for j in range(1, i)), F.lit(True))
    headers = F.struct(*(F.when(ahead(i), F.col(f"p{i}.title")).alias(f"h{i}") for i in range(1, LEVELS + 1)))
    parts = read.withColumn("headers", headers).groupBy("key", "part").agg(
        F.max("headings").alias("headings"), F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("headers", "at").alias("headers"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("own")
    )
    parts = parts.withColumn("content", F.array_join("own.line", "\n")).where((F.col("headings") > 0) | F.col("content").rlike(r"\S"))
    parts = parts.where((F.col("part") > 0) | F.col("content").rlike(r"\S"))  # nothing ahead of the first heading
    first = F.trim(F.get(F.col("own.line"), F.lit(0)))
    words = F.get(F.filter(F.transform("own.line", lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    said = F.when(F.length(words) > 50, F.concat(F.left(words, F.lit(50)), F.lit("..."))).otherwise(words)
    place = (F.row_number().over(Window.partitionBy("key").orderBy("part")) - 1).cast("int")
    name = F.when(F.col("headings") > 0, F.coalesce(_deepest(F.col("headers")), F.when(first.startswith("#"), F.ltrim(first, F.lit("# "))), F.concat(F.lit("Section "), place + 1))).otherwise(said)
    kind_of = F.when(F.col("headings") > 0, "markdown_section").otherwise("text_chunk")
    rest = parts.select("key", place.alias("section_order"), kind_of.alias("section_type"), name.alias("summary"), "headers", "content", (F.col("first") + 1).alias("start_line"), (F.col("last") + 1).alias("end_line"))
    return one.unionByName(rest).withColumnRenamed("key", key)
