"""Queries of documentation plans over the code-like view."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import graph as G
from graphloom.operators import planning as P
from graphloom.plans.code_queries import _ARCH, _DIR, _DOCT, _LAYER, _PRIO, _TESTED
from graphloom.plans.code_view import CODE_SQL, code_edges, code_nodes
from graphloom.plans.registry import query
from graphloom.plans.views import table

_W = f"WITH {CODE_SQL}"
_MEASURES = ["identity_score", "evidence", "docs_share", "public_api", "utility_share"]
r6 = lambda c: F.round(c, 6)

_MAP = f"mp AS (SELECT *, macro_cluster AS macro, coalesce(micro_cluster, 0) AS micro FROM cn WHERE {_ARCH} AND macro_cluster IS NOT NULL AND NOT {_TESTED})"
_IDENT = "symbol_type IN ('class', 'interface', 'trait', 'protocol', 'enum', 'struct', 'record', 'module', 'namespace', 'function')"
_SUPP = "symbol_type IN ('constant', 'type_alias', 'macro', 'method', 'property')"
_D = "symbol_type IN ('module_doc', 'file_doc')"
_CAND = f"""ct AS (SELECT macro, micro, count(*) AS n, count(*) FILTER ({_IDENT}) AS i, count(*) FILTER ({_IDENT} OR {_SUPP}) AS c, count(*) FILTER ({_D}) AS d, count(*) FILTER (NOT {_D} AND length(source_text) >= 50) AS b,
 count(*) FILTER (NOT {_D} AND NOT starts_with(symbol_name, '_')) AS p, count(*) FILTER (regexp_matches(lower(symbol_name), 'util|helper|misc|common|base|mixin|compat|internal|private')) AS u, count(DISTINCT rel_path) AS file_spread FROM mp GROUP BY 1, 2),
cd AS (SELECT macro, micro, n, i / n AS identity_score, b / greatest(c, 1) AS evidence, d / n AS docs_share, p / greatest(c, 1) AS public_api, u / n AS utility_share, file_spread,
 CASE WHEN d / n >= 0.7 THEN 'docs' WHEN file_spread >= 3 AND file_spread > n / 2 THEN 'bridge' WHEN d = 0 AND c > 0 THEN 'code' WHEN d > 0 AND c > 0 THEN 'mixed' ELSE 'code' END AS classification FROM ct)"""
_VALID = """vd AS (SELECT *, CASE WHEN classification = 'docs' OR identity_score >= 0.1 THEN 'pass' WHEN identity_score > 0 THEN 'warn' ELSE 'fail' END AS identity, CASE WHEN utility_share >= 0.5 OR n > most THEN 'warn' ELSE 'pass' END AS coherence,
 CASE WHEN classification = 'docs' OR evidence >= 0.2 THEN 'pass' ELSE 'warn' END AS grounding, CASE WHEN n < 2 THEN 'fail' ELSE 'pass' END AS coverage, CASE WHEN classification = 'bridge' THEN 'warn' ELSE 'pass' END AS shape
 FROM (SELECT *, count(*) OVER (PARTITION BY macro) - 1 AS siblings, greatest(60, floor(1.5 * avg(n) OVER ())) AS most FROM cd)),
ve AS (SELECT *, CASE WHEN identity = 'fail' THEN 'demote' WHEN coverage = 'fail' THEN 'merge_with' WHEN classification = 'docs' THEN 'promote_docs' WHEN coherence = 'warn' OR shape = 'warn' THEN 'split_by' WHEN (identity = 'warn' OR grounding = 'warn') AND siblings > 0 THEN 'merge_with' ELSE 'keep' END AS decision FROM vd)"""


def _pages(spark, sf):
    return P.candidates(P.cluster_map(code_nodes(spark, sf)))


@query("cluster_map", f"{_W}, {_MAP} SELECT macro, micro, count(*) AS n, min(node_id) AS first FROM mp GROUP BY 1, 2")
def cluster_map(spark, sf):
    return P.cluster_map(code_nodes(spark, sf)).groupBy("macro", "micro").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))


@query("all_clusters", f"{_W} SELECT macro_cluster AS macro, coalesce(micro_cluster, 0) AS micro, string_agg(node_id, ',' ORDER BY node_id) AS ids FROM cn GROUP BY 1, 2")
def all_clusters(spark, sf):
    own = code_nodes(spark, sf).where("macro_cluster IS NOT NULL").groupBy(F.col("macro_cluster").alias("macro"), F.coalesce("micro_cluster", F.lit(0)).alias("micro"))
    return own.agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("ids"))


_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURES)


@query("candidate_metrics", f"{_W}, {_MAP}, {_CAND} SELECT macro, micro, n, {_ROUND}, file_spread FROM cd")
def candidate_metrics(spark, sf):
    return _pages(spark, sf).select("macro", "micro", "n", *(r6(c).alias(c) for c in _MEASURES), "file_spread")


@query("candidate_class", f"{_W}, {_MAP}, {_CAND} SELECT macro, micro, classification FROM cd")
def candidate_class(spark, sf):
    return _pages(spark, sf).select("macro", "micro", "classification")


@query("candidate_checks", f"{_W}, {_MAP}, {_CAND}, {_VALID} SELECT macro, micro, identity, coherence, grounding, coverage, shape, decision FROM ve")
def candidate_checks(spark, sf):
    return P.validated(_pages(spark, sf)).select("macro", "micro", "identity", "coherence", "grounding", "coverage", "shape", "decision")


@query("settled_pages", f"{_W}, {_MAP}, {_CAND}, {_VALID}, lg AS (SELECT macro, arg_max(micro, (n, -micro)) AS largest FROM ve WHERE decision NOT IN ('demote', 'merge_with') GROUP BY 1) SELECT macro, micro, decision, CASE decision WHEN 'demote' THEN -1 WHEN 'merge_with' THEN coalesce(largest, micro) ELSE micro END AS \"into\" FROM ve LEFT JOIN lg USING (macro)")
def settled_pages(spark, sf):
    return P.settled(P.validated(_pages(spark, sf))).withColumn("into", F.coalesce("into", F.lit(-1)))


_COV = "cv AS (SELECT node_id FROM mp WHERE micro < 3)"


def _covered(spark, sf):
    return P.cluster_map(code_nodes(spark, sf)).where("micro < 3").select("node_id")


@query("coverage_report", f"{_W}, {_MAP}, {_COV}, u AS (SELECT node_id, CASE WHEN {_DIR} = '' THEN '.' ELSE {_DIR} END AS dir, {_DOCT} AS doc, node_id IN (FROM cv) AS held FROM cn WHERE {_ARCH}) SELECT count(*) AS total_symbols, count(*) FILTER (held) AS covered_symbols, count(DISTINCT dir) FILTER (doc) AS doc_domains, count(DISTINCT dir) FILTER (doc AND held) AS covered_doc_domains, count(DISTINCT dir) AS directories, count(DISTINCT dir) FILTER (held) AS covered_directories FROM u")
def coverage_report(spark, sf):
    return P.coverage_report(code_nodes(spark, sf), _covered(spark, sf))


@query("uncovered_symbols", f"{_W}, {_MAP}, {_COV} SELECT node_id, symbol_name, symbol_type, {_PRIO} AS priority FROM cn WHERE {_ARCH} AND {_PRIO} >= 7 AND node_id NOT IN (FROM cv) ORDER BY priority DESC, node_id LIMIT 20")
def uncovered_symbols(spark, sf):
    return P.uncovered_symbols(code_nodes(spark, sf), _covered(spark, sf))


@query("doc_clusters", f"{_W} SELECT macro_cluster AS macro, round(avg(({_DOCT})::INT), 6) AS share FROM cn GROUP BY 1 HAVING avg(({_DOCT})::INT) > 0.7")
def doc_clusters(spark, sf):
    """Sections of which more than 0.7 are documentation."""
    share = code_nodes(spark, sf).groupBy(F.col("macro_cluster").alias("macro")).agg(F.avg(S.is_doc_type(F.col("symbol_type")).cast("int")).alias("share"))
    return share.where(F.col("share") > P.DOCS_SHARE).withColumn("share", r6("share"))


@query("dominant_symbols", f"{_W}, s AS (SELECT macro_cluster AS macro, node_id, CAST(least(coalesce(o, 0), 10) + CASE WHEN docstring <> '' THEN 2 ELSE 0 END AS INT) AS score FROM cn LEFT JOIN (SELECT source_id, count(*) AS o FROM ce GROUP BY 1) ON source_id = node_id WHERE {_ARCH} AND macro_cluster IS NOT NULL) SELECT macro, node_id, score, CAST(row_number() OVER (PARTITION BY macro ORDER BY score DESC, node_id) AS INT) AS rank FROM s QUALIFY rank <= 10")
def dominant_symbols(spark, sf):
    return P.dominant_symbols(code_nodes(spark, sf), code_edges(spark, sf))


_DEGREE = "dg AS (SELECT node_id, count(*) AS connections FROM (SELECT source_id AS node_id FROM ce UNION ALL SELECT target_id FROM ce) GROUP BY 1)"
_CODE = "symbol_type IN ('class', 'interface', 'struct', 'enum', 'trait', 'function', 'constant', 'type_alias', 'macro')"
_SYM = f"{_DEGREE}, sy AS (SELECT node_id, symbol_name AS name, symbol_type AS type, CASE WHEN {_DIR} = '' THEN '.' ELSE {_DIR} END AS dir, rel_path, {_LAYER} AS layer, coalesce(connections, 0) AS connections FROM cn LEFT JOIN dg USING (node_id) WHERE {_CODE})"


def _symbols(spark, sf):
    n = code_nodes(spark, sf)
    return P.directory_symbols(n, G.degrees(n, code_edges(spark, sf)))


@query("directory_symbols", f"{_W}, {_SYM} SELECT dir, layer, count(*) AS n, CAST(sum(connections) AS BIGINT) AS connections FROM sy GROUP BY 1, 2")
def directory_symbols(spark, sf):
    return _symbols(spark, sf).groupBy("dir", "layer").agg(F.count("*").alias("n"), F.sum("connections").alias("connections"))


_WEIGHT = "CASE rel_type WHEN 'inheritance' THEN 3 WHEN 'composition' THEN 3 WHEN 'calls' THEN 2 WHEN 'creates' THEN 2 WHEN 'references' THEN 2 ELSE 0 END"


@query("directory_coupling", f"{_W}, d AS (SELECT node_id, {_DIR} AS dir FROM cn), k AS (SELECT DISTINCT {_DIR} AS dir FROM cn WHERE {_CODE}) SELECT least(a.dir, b.dir) AS a, greatest(a.dir, b.dir) AS b, CAST(sum({_WEIGHT}) AS BIGINT) AS weight FROM ce JOIN d a ON a.node_id = source_id JOIN d b ON b.node_id = target_id WHERE {_WEIGHT} > 0 AND a.dir <> b.dir AND a.dir IN (FROM k) AND b.dir IN (FROM k) GROUP BY 1, 2")
def directory_coupling(spark, sf):
    return P.directory_coupling(code_nodes(spark, sf), code_edges(spark, sf), _symbols(spark, sf))


@query("doc_directories", f"{_W}, k AS (SELECT DISTINCT {_DIR} AS dir FROM cn WHERE {_CODE}), x AS (SELECT {_DIR} AS dir, '.md' AS ending FROM cn WHERE rel_path LIKE '%.md' AND {_DIR} NOT IN (FROM k)) SELECT CASE WHEN len(string_split(dir, '/')) <= 2 THEN dir ELSE split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) END AS \"group\", count(*) AS files, min(ending) AS endings, count(DISTINCT dir) AS dirs FROM x GROUP BY 1")
def doc_directories(spark, sf):
    return P.doc_clusters(code_nodes(spark, sf).select("rel_path"), _symbols(spark, sf))


@query("prioritized_symbols", f"{_W}, {_SYM}, s AS (SELECT dir, node_id, name, CAST(CASE layer WHEN 'entry_point' THEN 6 WHEN 'public_api' THEN 5 WHEN 'core_type' THEN 4 WHEN 'infrastructure' THEN 3 WHEN 'internal' THEN 2 ELSE 1 END * 200 + least(connections, 100) AS INT) AS score FROM sy), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dir ORDER BY score DESC, node_id) AS INT) AS rank, count(*) OVER (PARTITION BY dir) AS n FROM s QUALIFY rank <= 30 OR n <= 30) SELECT dir, node_id, name, score, rank FROM r QUALIFY row_number() OVER (PARTITION BY dir, name ORDER BY rank) = 1 OR n <= 30")
def prioritized_symbols(spark, sf):
    return P.prioritized(_symbols(spark, sf))


@query("sibling_groups", f"""WITH RECURSIVE {CODE_SQL}, c AS (SELECT {_DIR} AS dir, count(*) AS n FROM cn WHERE {_CODE} GROUP BY 1), o AS (SELECT regexp_replace(dir, '/?[^/]*$', '') AS parent, dir, n, row_number() OVER (PARTITION BY regexp_replace(dir, '/?[^/]*$', '') ORDER BY dir) AS i FROM c),
f AS (SELECT parent, dir, i, 0 AS g, CASE WHEN n >= 20 THEN 1 ELSE 0 END AS nextg, CASE WHEN n >= 20 THEN 0 ELSE n END AS held FROM o WHERE i = 1 UNION ALL SELECT o.parent, o.dir, o.i, f.nextg, CASE WHEN f.held + o.n >= 20 THEN f.nextg + 1 ELSE f.nextg END, CASE WHEN f.held + o.n >= 20 THEN 0 ELSE f.held + o.n END FROM f JOIN o ON o.parent = f.parent AND o.i = f.i + 1)
SELECT parent, dir, g AS \"group\" FROM f""")
def sibling_groups(spark, sf):
    return P.sibling_groups(_symbols(spark, sf))


@query("graph_stats", f"{_W} SELECT 'language' AS part, language AS key, count(*) AS n FROM cn GROUP BY 2 UNION ALL SELECT 'symbol_type', symbol_type, count(*) FROM cn GROUP BY 2 UNION ALL SELECT 'rel_type', rel_type, count(*) FROM ce GROUP BY 2 UNION ALL SELECT 'macro_clusters', '', count(DISTINCT macro_cluster) FROM cn UNION ALL SELECT 'nodes', '', count(*) FROM cn UNION ALL SELECT 'edges', '', count(*) FROM ce")
def graph_stats(spark, sf):
    """Counts by language, type and relation, sections, nodes and edges."""
    n, e = code_nodes(spark, sf), code_edges(spark, sf)
    by = lambda df, c: df.groupBy(F.lit(c).alias("part"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    one = lambda df, part, x: df.agg(x.alias("n")).select(F.lit(part).alias("part"), F.lit("").alias("key"), "n")
    rows = by(n, "language").union(by(n, "symbol_type")).union(by(e, "rel_type"))
    return rows.union(one(n, "macro_clusters", F.countDistinct("macro_cluster"))).union(one(n, "nodes", F.count("*"))).union(one(e, "edges", F.count("*")))


@query("graph_files", f"{_W} SELECT DISTINCT rel_path FROM cn WHERE rel_path <> ''")
def graph_files(spark, sf):
    return code_nodes(spark, sf).select("rel_path").where("rel_path <> ''").distinct()


@query("language_stats", f"{_W} SELECT c.language, count(DISTINCT rel_path) AS files, count(*) AS symbols, CAST(sum(coalesce(o, 0)) AS BIGINT) AS relationships FROM cn c LEFT JOIN (SELECT source_id, count(*) AS o FROM ce GROUP BY 1) ON source_id = node_id GROUP BY 1")
def language_stats(spark, sf):
    out = code_edges(spark, sf).groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("o"))
    return code_nodes(spark, sf).join(out, "node_id", "left").groupBy("language").agg(F.countDistinct("rel_path").alias("files"), F.count("*").alias("symbols"), F.sum(F.coalesce("o", F.lit(0))).alias("relationships"))


@query("repository_root", "WITH f AS (SELECT '/work/tree/' || 'src/' || p_partkey || '.py' AS long_path, 'src/' || p_partkey || '.py' AS short_path FROM part ORDER BY p_partkey LIMIT 500) SELECT regexp_replace(substr(long_path, 1, length(long_path) - length(short_path)), '/$', '') AS root, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, root LIMIT 1")
def repository_root(spark, sf):
    """The most frequent prefix that full paths have before relative ones, of the first 500 (as the rule has it)."""
    files = table(spark, sf, "part").orderBy("p_partkey").limit(500).selectExpr("'/work/tree/src/' || CAST(p_partkey AS STRING) || '.py' AS full", "'src/' || CAST(p_partkey AS STRING) || '.py' AS rel")
    root = F.regexp_replace(F.substr("full", F.lit(1), F.length("full") - F.length("rel")), "/$", "")
    return files.where(F.col("full").endswith(F.col("rel"))).groupBy(root.alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)


@query("planning_sizes", "SELECT o_orderkey AS k, CASE WHEN o_orderkey < 10 THEN 5 ELSE CAST(greatest(5, least(20, ceil(1.2 * log2(greatest(o_orderkey, 10))))) AS INT) END AS sections, CAST(greatest(8, least(200, ceil(sqrt(o_orderkey / 7)))) AS INT) AS pages, CASE WHEN o_orderkey >= 5000 THEN 15 WHEN o_orderkey >= 1000 THEN 12 WHEN o_orderkey >= 200 THEN 8 ELSE 5 END AS central, CASE WHEN o_orderkey >= 5000 THEN 50 WHEN o_orderkey >= 2000 THEN 40 WHEN o_orderkey >= 500 THEN 30 ELSE 25 END AS per_page, CASE WHEN o_orderkey < 6 THEN 2 ELSE CAST(greatest(2, least(8, round_even(3 * log10(greatest(o_orderkey, 1)), 0))) AS INT) END AS section_pages FROM orders")
def planning_sizes(spark, sf):
    k = F.col("k")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select("k", S.target_sections(k).alias("sections"), S.target_pages(k).alias("pages"), S.central_count(k).alias("central"), S.symbols_per_page(k).alias("per_page"), S.page_count_cap(k).alias("section_pages"))
