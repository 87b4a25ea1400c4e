"""Queries of expansion, ranking, chunking and surfaces over the code-like view."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import expand as X
from graphloom.operators import graph as G
from graphloom.operators import linkage as L
from graphloom.operators import ranking as R
from graphloom.operators import resolve as V
from graphloom.operators import surfaces as U
from graphloom.plans.code_queries import _ARCH, _CW, _DIR, _DOCT, _TESTED
from graphloom.plans.code_view import CODE_SQL, code_edges, code_nodes
from graphloom.plans.registry import query
from graphloom.plans.symbol_queries import index
from graphloom.plans.views import table
from graphloom.sources import stores

_W = f"WITH {CODE_SQL}"


def _rules_sql() -> str:
    rows = []
    for i, (types, direction, rels, most, other, via) in enumerate(X.GRAPH_RULES):
        q = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]" if xs else "NULL::VARCHAR[]"
        rows += [f"({i}, '{t}', '{direction}', '{r}', {most}, {q(other)}, {q(via or ())}, {str(via is not None).lower()})" for t in types for r in rels]
    return "rl AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(rule, seed_type, direction, rel_type, most, types, via, two))"


_RULED = f"""{_rules_sql()}, de AS (SELECT DISTINCT source_id, target_id, rel_type FROM ce), ac AS (SELECT 'out' AS direction, source_id AS node_id, target_id AS other, rel_type FROM de UNION ALL SELECT 'in', target_id, source_id, rel_type FROM de),
fd AS (SELECT a.node_id AS seed, a.other, r.rule, r.most, r.types FROM ac a JOIN cn s USING (node_id) JOIN rl r ON NOT r.two AND r.seed_type = s.symbol_type AND r.direction = a.direction AND r.rel_type = a.rel_type
 UNION ALL SELECT d.source_id, e.target_id, r.rule, r.most, r.types FROM de d JOIN cn s ON s.node_id = d.source_id JOIN cn m ON m.node_id = d.target_id JOIN rl r ON r.two AND r.seed_type = s.symbol_type AND list_contains(r.via, m.symbol_type) JOIN de e ON e.source_id = d.target_id AND e.rel_type = r.rel_type WHERE d.rel_type = 'defines'),
fe AS (SELECT DISTINCT seed, other, rule, most FROM fd JOIN cn o ON o.node_id = other WHERE seed <> other AND (types IS NULL OR list_contains(types, o.symbol_type))),
fr AS (SELECT seed, other, min(rule) AS rule FROM (SELECT * FROM fe QUALIFY row_number() OVER (PARTITION BY seed, rule ORDER BY other) <= most) GROUP BY 1, 2)"""


@query("expand_graph_rules", f"{_W}, {_RULED} SELECT seed, other, rule, CAST(row_number() OVER (PARTITION BY seed ORDER BY rule, other) AS INT) AS rank FROM fr QUALIFY rank <= 15")
def expand_graph_rules(spark, sf):
    n = code_nodes(spark, sf)
    return X.expanded_by_graph(n, n, code_edges(spark, sf))


@query("expand_other_types", f"{_W} SELECT source_id AS seed, target_id AS other, rel_type FROM (SELECT DISTINCT source_id, target_id, rel_type FROM ce WHERE rel_type <> 'defines') JOIN cn ON node_id = source_id WHERE symbol_type = 'method' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY target_id, rel_type) <= 5")
def expand_other_types(spark, sf):
    return X.expanded_otherwise(code_nodes(spark, sf).where("symbol_type = 'method'"), code_edges(spark, sf))


def _as(e, given: str, wanted: str):
    return e.withColumn("rel_type", F.when(F.col("rel_type") == given, wanted).otherwise(F.col("rel_type")))


@query("expand_language_hints", f"{_W}, de AS (SELECT DISTINCT source_id, target_id FROM ce WHERE rel_type = 'inheritance'), ac AS (SELECT 'out' AS direction, source_id AS node_id, target_id AS other FROM de UNION ALL SELECT 'in', target_id, source_id FROM de) SELECT DISTINCT node_id AS seed, other, direction FROM (SELECT * FROM ac JOIN cn USING (node_id) WHERE language IN ('java', 'rust') QUALIFY row_number() OVER (PARTITION BY node_id, direction ORDER BY other) <= 5)")
def expand_language_hints(spark, sf):
    """Implementations (edges of inheritance stand for them) by the hints of the seeds' languages."""
    return X.hint_relations(code_nodes(spark, sf), _as(code_edges(spark, sf), "inheritance", "implementation"))


@query("worth_expanding", f"{_W} SELECT node_id FROM cn WHERE NOT (symbol_type = 'macro' AND language = 'cpp')")
def worth_expanding(spark, sf):
    return X.worth_expanding(code_nodes(spark, sf)).select("node_id")


@query("language_hints", f"{_W} SELECT DISTINCT language, CASE language WHEN 'cpp' THEN 'namespace' WHEN 'go' THEN 'package' WHEN 'java' THEN 'package' ELSE 'module' END AS grouping, CASE language WHEN 'cpp' THEN 2.0::DOUBLE WHEN 'go' THEN 1.5::DOUBLE WHEN 'java' THEN 1.2::DOUBLE WHEN 'rust' THEN 1.8::DOUBLE WHEN 'typescript' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS priority, round(least(0.6, greatest(0.1, 0.3 * CASE language WHEN 'cpp' THEN 2.0 WHEN 'go' THEN 1.5 WHEN 'java' THEN 1.2 WHEN 'rust' THEN 1.8 WHEN 'typescript' THEN 1.3 ELSE 1.0 END)), 6)::DOUBLE AS fraction FROM cn")
def language_hints(spark, sf):
    return X.hints(code_nodes(spark, sf)).select("language", "grouping", "priority", F.round("fraction", 6).alias("fraction"))


@query("valid_expansions", f"{_W} SELECT DISTINCT source_id AS seed, target_id AS other FROM ce JOIN cn ON node_id = target_id WHERE rel_type = 'calls' AND macro_cluster = 2 AND NOT {_TESTED} AND symbol_type IN ('class', 'interface', 'struct', 'enum', 'trait', 'function', 'constant', 'type_alias', 'macro', 'module_doc', 'file_doc')")
def valid_expansions(spark, sf):
    found = code_edges(spark, sf).where("rel_type = 'calls'").select(F.col("source_id").alias("seed"), F.col("target_id").alias("other")).distinct()
    return X.valid_expansions(found, code_nodes(spark, sf), macro=2)


@query("page_neighbours", f"{_W}, {_CW}, b AS (SELECT seed, other, max(weight) AS weight FROM (SELECT source_id AS seed, target_id AS other, weight FROM w UNION ALL SELECT target_id, source_id, weight FROM w) WHERE seed <> other GROUP BY 1, 2), t AS (SELECT * FROM b JOIN cn s ON s.node_id = seed WHERE s.symbol_type = 'class' QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(weight, 9) DESC, other) <= 15) SELECT seed, other, round(weight, 6) AS weight FROM t JOIN cn o ON o.node_id = other WHERE {_ARCH.replace('symbol_type', 'o.symbol_type')}")
def page_neighbours(spark, sf):
    n = code_nodes(spark, sf)
    weighted = G.edge_weights(code_edges(spark, sf)).withColumn("weight", F.round("weight", 9))
    return X.page_neighbours(n.where("symbol_type = 'class'").select("node_id"), n, weighted).withColumn("weight", F.round("weight", 6))


@query("framework_references")
def framework_references(spark, sf):
    """Texts that name a class, which is not theirs."""
    n = code_nodes(spark, sf)
    return X.framework_references(n.where("symbol_type = 'class'"), n, index(spark, sf))


@query("section_documents", f"{_W} SELECT macro_cluster AS section, node_id FROM cn WHERE {_DOCT} AND macro_cluster = 4 ORDER BY rel_path, node_id LIMIT 200")
def section_documents(spark, sf):
    own = code_nodes(spark, sf).where(S.is_doc_type(F.col("symbol_type")) & (F.col("macro_cluster") == 4))
    return own.orderBy("rel_path", "node_id").limit(200).select(F.col("macro_cluster").alias("section"), "node_id")


@query("page_symbols", f"{_W} SELECT symbol_name, node_id FROM cn WHERE macro_cluster = 2 AND {_ARCH} QUALIFY row_number() OVER (PARTITION BY symbol_name ORDER BY end_line - start_line DESC, node_id) <= 5")
def page_symbols(spark, sf):
    """Names of a section's symbols to their nodes, the longest first, at most five."""
    from pyspark.sql import Window

    own = code_nodes(spark, sf).where(S.is_architectural_type(F.col("symbol_type")) & (F.col("macro_cluster") == 2))
    place = F.row_number().over(Window.partitionBy("symbol_name").orderBy((F.col("end_line") - F.col("start_line")).desc(), "node_id"))
    return own.select("symbol_name", "node_id", place.alias("place")).where(F.col("place") <= 5).select("symbol_name", "node_id")


@query("architectural_parents")
def architectural_parents(spark, sf):
    return V.architectural_parent(code_nodes(spark, sf), code_edges(spark, sf))


_SC = "CASE WHEN symbol_type IN ('class', 'interface', 'struct', 'trait') THEN 10 WHEN symbol_type IN ('enum', 'text_chunk') THEN 8 WHEN symbol_type IN ('function', 'constant', 'type_alias') THEN 7 WHEN symbol_type = 'method' THEN 6 WHEN symbol_type = 'module' THEN 5 WHEN symbol_type = 'macro' THEN 3 ELSE 1 END"


@query("ranked_documents", f"""WITH RECURSIVE {CODE_SQL}, hop AS (SELECT 'p:10' AS node_id, 0 AS h UNION SELECT target_id, h + 1 FROM hop JOIN ce ON source_id = hop.node_id WHERE h < 2), mh AS (SELECT node_id, min(h) AS h FROM hop GROUP BY 1),
ti AS (SELECT node_id, sum(w) AS w FROM (SELECT CASE WHEN source_id = 'p:10' THEN target_id ELSE source_id END AS node_id, CASE rel_type WHEN 'defines' THEN 15 WHEN 'calls' THEN 12 WHEN 'creates' THEN 12 WHEN 'inheritance' THEN 10 WHEN 'composition' THEN 8 WHEN 'references' THEN 8 ELSE 0 END AS w FROM ce WHERE source_id = 'p:10' OR target_id = 'p:10') GROUP BY 1), tp AS (SELECT rel_path AS p FROM cn WHERE node_id = 'p:10')
SELECT node_id, (CASE WHEN contains(rel_path, 'src/small') THEN 20 ELSE 0 END + coalesce(w, 0) + {_SC} + CASE WHEN rel_path = p THEN 8 WHEN {_DIR} = regexp_replace(p, '/?[^/]*$', '') THEN 5 ELSE 0 END + CASE WHEN h IS NULL THEN -5.0 ELSE -0.5 * h END + CASE WHEN length(source_text) < 5000 THEN 0 WHEN length(source_text) < 10000 THEN -1 ELSE -2 END)::DOUBLE AS score FROM cn LEFT JOIN ti USING (node_id) LEFT JOIN mh USING (node_id), tp""")
def ranked_documents(spark, sf):
    """Scores for a page about one node, reached within two hops."""
    return R.document_scores(code_nodes(spark, sf), code_edges(spark, sf), "p:10", ("src/small",), 2)


@query("tier_assign")
def tier_assign(spark, sf):
    """Documents of each section, best score first, into the budgets of the three tiers."""
    n = code_nodes(spark, sf)
    scores = R.document_scores(n, code_edges(spark, sf), "p:10", ("src/small",), 2)
    rows = n.select("node_id", "macro_cluster", R.fallback_tokens(F.col("source_text")).alias("tokens")).join(scores, "node_id").withColumn("order", -F.col("score"))
    return X.tiers(rows, "macro_cluster", ["order", "node_id"], "tokens", ((1.0, 50_000), (0.35, 30_000), (0.10, 10_000)))


@query("document_tokens", f"{_W} SELECT node_id, CAST(length(source_text) // 4 + length(symbol_name || ' ' || rel_path || ' ' || symbol_type) // 4 + 20 AS BIGINT) AS tokens FROM cn")
def document_tokens(spark, sf):
    return code_nodes(spark, sf).select("node_id", R.document_tokens(F.col("source_text"), F.col("symbol_name"), F.col("rel_path"), F.col("symbol_type")).alias("tokens"))


@query("line_chunks", r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, length(text) <= 17000 AS whole FROM documents), c AS (SELECT doc_id, whole, i AS chunk, CASE WHEN whole THEN l ELSE l[i * 30 + 1:i * 30 + 30] END AS own, l FROM (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE range(0, (len(l) - 1) // 30 + 1) END) AS i FROM d))
SELECT doc_id, CAST(chunk AS INT) AS chunk, length(array_to_string(own, chr(10))) AS chars, CAST(chunk * 30 + 1 AS INT) AS start_line, CAST(chunk * 30 + len(own) AS INT) AS end_line FROM c WHERE whole OR regexp_matches(array_to_string(own, chr(10)), '\S')""")
def line_chunks(spark, sf):
    return R.line_chunks(table(spark, sf, "documents"), "doc_id").select("doc_id", "chunk", F.length("content").alias("chars"), "start_line", "end_line")


@query("compressed_documents")
def compressed_documents(spark, sf):
    n = code_nodes(spark, sf).withColumn("tier", F.length("symbol_name") % 3 + 1)
    return R.compressed(n).select("node_id", "tier", F.length("content").alias("chars"))


_ROUTED = "CASE language WHEN 'python' THEN '@app.get(\"/api/v1/' || lower(symbol_type) || '\")' || chr(10) || 'def x(): pass' WHEN 'typescript' THEN 'fetch(\"/' || lower(symbol_type) || '\")' WHEN 'go' THEN 'r.GET(\"/' || lower(symbol_type) || '\", h)' ELSE '' END"


@query("surface_extract", f"{_W} SELECT node_id, 'rest' AS kind, unnest(CASE language WHEN 'python' THEN ['GET /api/v1/' || symbol_type, 'GET /' || symbol_type] ELSE ['GET /' || symbol_type] END) AS surface, unnest(CASE language WHEN 'python' THEN [0.7::DOUBLE, 0.6::DOUBLE] ELSE [0.7::DOUBLE] END) AS hint FROM cn WHERE language IN ('python', 'typescript', 'go')")
def surface_extract(spark, sf):
    """Routes that are put into the texts of three languages, with the alternate that a gateway's prefix leaves."""
    n = code_nodes(spark, sf).withColumn("source_text", F.expr(_ROUTED))
    return U.extracted(n).withColumn("hint", F.round("hint", 6))


@query("surfaces_across_languages")
def surfaces_across_languages(spark, sf):
    """Links of the routes above between nodes of two languages."""
    n = code_nodes(spark, sf)
    found = U.extracted(n.where("macro_cluster = 1").withColumn("source_text", F.expr(_ROUTED)))
    return L.surface_links(n, found).groupBy("surface").agg(F.count("*").alias("n"), F.round(F.min("weight"), 6).alias("least"))


@query("stored_flags", f"{_W} SELECT node_id, symbol_type, {_ARCH} AS is_architectural, {_DOCT} AS is_doc, {_TESTED} AS is_test FROM cn")
def stored_flags(spark, sf):
    """What an upsert makes of given types in capitals and wrong flags."""
    given = code_nodes(spark, sf).withColumn("symbol_type", F.upper("symbol_type")).withColumn("is_doc", F.lit(True))
    return stores.flagged(given).select("node_id", "symbol_type", "is_architectural", "is_doc", "is_test")


@query("merged_nodes", f"{_W} SELECT node_id, CASE WHEN symbol_type = 'class' THEN 'new' ELSE 'old' END AS version FROM cn")
def merged_nodes(spark, sf):
    """Old rows with new ones in their place."""
    old = code_nodes(spark, sf).select("node_id", "symbol_type").withColumn("version", F.lit("old"))
    new = old.where("symbol_type = 'class'").withColumn("version", F.lit("new"))
    return stores.merged(old, new, "node_id").select("node_id", "version")


@query("name_parts", f"{_W} SELECT node_id, lower(regexp_replace(regexp_replace(symbol_name, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, '<' || symbol_type || ', ' || language || '>' AS args, regexp_replace('/work/' || rel_path, '^/work/', '') AS rel FROM cn")
def name_parts(spark, sf):
    return code_nodes(spark, sf).select("node_id", S.snake(F.col("symbol_name")).alias("snake"), S.type_args(F.array("symbol_type", "language")).alias("args"), S.relative_path(F.concat(F.lit("/work/"), F.col("rel_path")), "/work").alias("rel"))


@query("docstring_summaries", f"{_W} SELECT node_id, docstring AS summary FROM cn")
def docstring_summaries(spark, sf):
    """The first line that says something: here docstrings stand in comment marks, after a line of parameters."""
    wrapped = F.when(F.col("docstring") == "", "").otherwise(F.concat(F.lit("/** Args:\n * @param x the x\n * "), F.col("docstring"), F.lit("\n */")))
    return code_nodes(spark, sf).select("node_id", S.first_line(wrapped).alias("summary"))


@query("repository_ids", "SELECT n_nationkey, 'org/' || lower(n_name) || ':' || CASE WHEN n_nationkey % 2 = 0 THEN 'main' ELSE 'dev' END || CASE WHEN n_nationkey % 3 = 0 THEN ':01234567' ELSE '' END AS id FROM nation")
def repository_ids(spark, sf):
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    return n.select("n_nationkey", S.repository_id(F.concat(F.lit(" /org/"), F.lower("n_name"), F.lit("/")), F.when(key % 2 == 0, " ").otherwise("dev"), F.when(key % 3 == 0, "0123456789abcdef")).alias("id"))


@query("plain_unicode", r"SELECT doc_id, length(regexp_replace(text, '[\p{Z}\p{C}]', ' ', 'g')) AS n, length(regexp_replace(regexp_replace(text, '[\p{Z}\p{C}]', ' ', 'g'), '[^ ]', '', 'g')) AS spaces FROM documents")
def plain_unicode(spark, sf):
    t = S.plain_unicode(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).alias("n"), F.length(F.regexp_replace(t, "[^ ]", "")).alias("spaces"))
