"""Queries of sections, folder trees, text stores and vector lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import sections as C
from graphloom.operators import tree as T
from graphloom.operators.vector_index import VectorIndex
from graphloom.plans.code_view import CODE_SQL, code_nodes
from graphloom.plans.registry import query
from graphloom.plans.views import table, vectors
from graphloom.sources import docstore
from graphloom.sources.shared import scratch

#: Headings and fences put where lines of the documents begin with certain letters.
_HEADINGS = (("[A-F]", "# "), ("[G-M]", "## "), ("[N-R]", "### "), ("[S-T]", "#### "), ("[U-Z]", "```"))


def _marked(documents):
    text = F.coalesce("text", F.lit(""))
    for letters, mark in _HEADINGS:
        text = F.regexp_replace(text, f"\n({letters})", f"\n{mark}$1" if mark != "```" else "\n```\n$1")
    kind = F.when(F.col("doc_id") % 5 == 4, "text").otherwise("markdown")
    plain = F.when(F.col("doc_id") % 7 == 0, F.coalesce("text", F.lit(""))).otherwise(text)
    return documents.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), kind.alias("kind"), plain.alias("text"))


def _marked_sql() -> str:
    text = "coalesce(text, '')"
    for letters, mark in _HEADINGS:
        text = f"regexp_replace({text}, '\\n({letters})', chr(10) || '{mark}' || {'chr(10) || ' if mark == '```' else ''}'\\1', 'g')"
    return f"SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'text' ELSE 'markdown' END AS kind, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') ELSE {text} END AS body FROM documents"


_STACK = ", ".join(f"last_value(CASE WHEN level = {i} THEN pos END IGNORE NULLS) OVER o AS a{i}, last_value(CASE WHEN level = {i} THEN title END IGNORE NULLS) OVER o AS t{i}" for i in range(1, 5))
_LIVE = [" AND ".join([f"a{i} IS NOT NULL", *(f"(a{j} IS NULL OR a{i} > a{j})" for j in range(1, i))]) for i in range(1, 5)]
_DEEP = "CASE " + " ".join(f"WHEN {_LIVE[i - 1]} THEN t{i}" for i in range(4, 0, -1)) + " END"
_PATH = "concat_ws(' > ', " + ", ".join(f"CASE WHEN {_LIVE[i - 1]} THEN t{i} END" for i in range(1, 5)) + ")"


@query("section_tree", rf"""WITH d AS ({_marked_sql()}), l AS (SELECT doc_id, kind, line, pos - 1 AS pos FROM (SELECT doc_id, kind, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM d WHERE length(body) > 1500)),
f AS (SELECT *, (kind = 'markdown' AND regexp_matches(line, '^\s*(```|~~~)'))::INT AS fence FROM l), g AS (SELECT *, (sum(fence) OVER (PARTITION BY doc_id ORDER BY pos) - fence) % 2 = 1 AS fenced FROM f),
v AS (SELECT *, CASE WHEN kind = 'markdown' AND NOT fenced AND fence = 0 THEN length(regexp_extract(line, '^(#{{1,4}})([ \t]|$)', 1)) ELSE 0 END AS level FROM g),
t AS (SELECT *, CASE WHEN level > 0 THEN trim(regexp_replace(line, '^#+\s*|\s*#*\s*$', '', 'g')) END AS title, max(level) OVER (PARTITION BY doc_id) AS headings, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM v),
s AS (SELECT *, {_STACK} FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, CASE WHEN headings > 0 THEN section ELSE pos // CASE WHEN kind = 'markdown' THEN 50 ELSE 30 END END AS part, any_value(headings) AS headings, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, arg_min({_DEEP}, pos) AS deep, coalesce(arg_min({_PATH}, pos), '') AS path, string_agg(line, chr(10) ORDER BY pos) AS content FROM s GROUP BY 1, 2)
SELECT doc_id, CAST(0 AS INT) AS section_order, kind || '_document' AS section_type, '' AS path, CAST(1 AS INT) AS start_line, CAST(len(string_split(body, chr(10))) AS INT) AS end_line, md5(body) AS content FROM d WHERE length(body) <= 1500
UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT), CASE WHEN headings > 0 THEN 'markdown_section' ELSE 'text_chunk' END, path, CAST(start_line AS INT), CAST(end_line AS INT), md5(content) FROM p WHERE (headings > 0 AND part > 0) OR regexp_matches(content, '\S')""")
def section_tree(spark, sf):
    """All documents, with headings and fences put in, cut into sections; shorter ones than usual are cut so that many are."""
    found = C.chunked(_marked(table(spark, sf, "documents")), "doc_id", "path", "kind", whole=1500)
    return found.select("doc_id", "section_order", "section_type", F.concat_ws(" > ", *(f"headers.h{i}" for i in range(1, 5))).alias("path"), "start_line", "end_line", F.md5("content").alias("content"))


_TREE_FILES = "SELECT rel_path FROM cn UNION ALL SELECT 'src/' || replace(lower(p_type), ' ', '/') || CASE p_partkey % 9 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/.hidden' WHEN 2 THEN '/.github' WHEN 3 THEN '/_own' ELSE '/deep/er' END || '/' || split_part(p_name, ' ', 1) || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.bin' END FROM part"
_SQL_IGNORED = f"x IN ({', '.join(repr(n) for n in T.IGNORED)}) OR (starts_with(x, '.') AND x NOT IN ({', '.join(repr(n) for n in T.SHOWN_DOTS)})) OR starts_with(x, '_') OR ends_with(x, '.egg-info')"


def _ends(which: tuple[str, ...]) -> str:
    return f"lower(regexp_extract(file, '[^.].*\\.([^.]+)$', 1)) IN ({', '.join(repr(e) for e in which)})"


@query("folder_tree", f"""WITH {CODE_SQL}, f AS (SELECT parts[len(parts)] AS file, parts[1:len(parts) - 1] AS dirs FROM (SELECT string_split(rel_path, '/') AS parts FROM ({_TREE_FILES}))), k AS (SELECT dirs, ({_ends(T.CODE_ENDINGS)})::INT AS code, (NOT {_ends(T.CODE_ENDINGS)} AND {_ends(T.DOC_ENDINGS)})::INT AS doc FROM f WHERE len(list_filter(dirs, lambda x: {_SQL_IGNORED})) = 0),
u AS (SELECT dirs[1:i] AS d, i = len(dirs) AS own, code, doc FROM (SELECT *, unnest(range(0, len(dirs) + 1)) AS i FROM k)), g AS (SELECT d, count(*) FILTER (own) AS files, coalesce(sum(code) FILTER (own), 0) AS code_files, coalesce(sum(doc) FILTER (own), 0) AS doc_files, count(*) AS all_files, sum(code) AS all_code, sum(doc) AS all_docs FROM u GROUP BY 1)
SELECT array_to_string(d, '/') AS path, d[len(d)] AS name, CAST(len(d) AS INT) AS depth, CAST(files AS BIGINT) AS files, CAST(code_files AS BIGINT) AS code_files, CAST(doc_files AS BIGINT) AS doc_files, (SELECT count(*) FROM g b WHERE len(b.d) = len(g.d) + 1 AND b.d[1:len(g.d)] = g.d) AS subdirs, CAST(all_files AS BIGINT) AS all_files, CAST(all_code AS BIGINT) AS all_code, CAST(all_docs AS BIGINT) AS all_docs
FROM g WHERE len(d) BETWEEN 1 AND 5 ORDER BY depth, path LIMIT 1000""")
def folder_tree(spark, sf):
    """Folders of all nodes' files, and of files in folders that are left out."""
    made = table(spark, sf, "part").selectExpr("'src/' || replace(lower(p_type), ' ', '/') || CASE p_partkey % 9 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/.hidden' WHEN 2 THEN '/.github' WHEN 3 THEN '/_own' ELSE '/deep/er' END || '/' || split_part(p_name, ' ', 1) || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.bin' END AS rel_path")
    return T.folder_tree(code_nodes(spark, sf).select("rel_path").unionByName(made))


@query("docstore_texts", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(coalesce(text, '')) AS text, lang || '/' || source AS metadata FROM documents WHERE doc_id % 3 <> 1")
def docstore_texts(spark, sf):
    """All documents written to a text store, then all but every third fetched by id."""
    docs = table(spark, sf, "documents")
    folder = scratch(spark, "texts")
    docstore.write_docstore(docs.select(F.col("doc_id").alias("id"), "text", F.concat_ws("/", "lang", "source").alias("metadata")), folder, 1 << 20)
    return docstore.fetch(spark, folder, docs.where("doc_id % 3 <> 1").select(F.col("doc_id").alias("id"))).select("id", F.md5("text").alias("text"), "metadata")


def _vector_index(spark, sf) -> VectorIndex:
    return VectorIndex.build(vectors(spark, sf).select(F.col("vec_id").alias("id"), "embedding"), scratch(spark, "vectors"), lists=24)


def _asked(spark, sf):
    return vectors(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding")


_EXACT = "SELECT CAST(a.vec_id AS VARCHAR) AS query, CAST(b.vec_id AS VARCHAR) AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), CAST(b.vec_id AS VARCHAR)) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"


@query("vector_lists_exact", f"SELECT query, id, distance, CAST(rank AS INT) AS rank FROM ({_EXACT}) WHERE rank <= 10")
def vector_lists_exact(spark, sf):
    """The nearest of all vectors by an index whose lists are all read."""
    own = _vector_index(spark, sf)
    return own.search(_asked(spark, sf), 10, len(own.centres)).withColumn("distance", F.round("distance", 6))


@query("vector_lists_near")
def vector_lists_near(spark, sf):
    """The same with the number of lists that the index measured; what it finds of the exact ones is a test."""
    return _vector_index(spark, sf).search(_asked(spark, sf), 10).withColumn("distance", F.round("distance", 6))
