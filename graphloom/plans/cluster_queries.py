"""Queries of clustering over the code-like view.  Communities and folds have no SQL; tests hold them against their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import clustering as C
from graphloom.operators import graph as G
from graphloom.operators.leiden import leiden, numbered
from graphloom.plans.code_queries import _CW, _DIR
from graphloom.plans.code_view import CODE_SQL, code_edges, code_nodes
from graphloom.plans.planning_queries import _symbols
from graphloom.plans.registry import query
from graphloom.sources.shared import written

_W = f"WITH {CODE_SQL}"
_PAR = "pa AS (SELECT c.node_id, CASE WHEN c.symbol_type IN ('method', 'constructor', 'field', 'variable', 'property', 'parameter', 'attribute') THEN coalesce(i.node_id, c.node_id) ELSE c.node_id END AS parent FROM cn c LEFT JOIN cn i ON i.node_id = c.parent_symbol)"


@query("projection_parents", f"{_W}, {_PAR} SELECT * FROM pa")
def projection_parents(spark, sf):
    return C.parents(code_nodes(spark, sf))


@query("projected_edges", f"{_W}, {_PAR} SELECT a.parent AS source_id, b.parent AS target_id, rel_type, count(*) AS n FROM ce JOIN pa a ON a.node_id = source_id JOIN pa b ON b.node_id = target_id WHERE a.parent <> b.parent GROUP BY 1, 2, 3")
def projected_edges(spark, sf):
    return C.projected(code_nodes(spark, sf), code_edges(spark, sf)).groupBy("source_id", "target_id", "rel_type").agg(F.count("*").alias("n"))


def _weighted(spark, sf):
    return G.edge_weights(code_edges(spark, sf))


def _macro(spark, sf):
    return code_nodes(spark, sf).select("node_id", F.col("macro_cluster").alias("cluster"))


@query("cluster_affinity", f"{_W}, {_CW} SELECT least(a.macro_cluster, b.macro_cluster) AS a, greatest(a.macro_cluster, b.macro_cluster) AS b, round(sum(weight), 4) AS weight FROM w JOIN cn a ON a.node_id = source_id JOIN cn b ON b.node_id = target_id WHERE a.macro_cluster <> b.macro_cluster GROUP BY 1, 2")
def cluster_affinity(spark, sf):
    return C.affinity(_weighted(spark, sf), _macro(spark, sf)).withColumn("weight", F.round("weight", 4))


@query("merged_sections")
def merged_sections(spark, sf):
    """Sections merged by affinity until four are left: their sizes."""
    return C.merged_to_cap(_weighted(spark, sf), _macro(spark, sf), 4).groupBy("cluster").count()


@query("merged_pages")
def merged_pages(spark, sf):
    """Pages of each section merged by affinity until two are left."""
    own = code_nodes(spark, sf).select("node_id", F.col("macro_cluster").alias("section"), F.coalesce("micro_cluster", F.lit(0)).alias("cluster"))
    return C.merged_to_cap(_weighted(spark, sf), own, 2, "section").groupBy("section", "cluster").count()


@query("consolidated_sections")
def consolidated_sections(spark, sf):
    """Sections merged by shared directories until five are left."""
    return C.consolidated(code_nodes(spark, sf), _macro(spark, sf), 5).groupBy("cluster").count()


@query("file_chunks", f"{_W} SELECT node_id, rel_path, CAST(floor((row_number() OVER (PARTITION BY rel_path ORDER BY start_line, node_id) - 1) / 3) AS INT) AS chunk FROM cn")
def file_chunks(spark, sf):
    return C.file_chunks(code_nodes(spark, sf), 3)


@query("scope_chunks", f"{_W}, s AS (SELECT node_id, rel_path, start_line, CASE WHEN coalesce(parent_symbol, '') <> '' THEN parent_symbol ELSE '__toplevel__' END AS scope, count(*) OVER (PARTITION BY rel_path) AS n FROM cn) SELECT node_id, rel_path, CASE WHEN n <= 3 THEN '' ELSE scope || '#' || CAST(floor((row_number() OVER (PARTITION BY rel_path, scope ORDER BY start_line, node_id) - 1) / 3) AS INT) END AS part FROM s")
def scope_chunks(spark, sf):
    return C.scope_chunks(code_nodes(spark, sf), 3)


@query("file_sections")
def file_sections(spark, sf):
    """Communities of the file graph, by which every node gets a section."""
    return C.sections(code_nodes(spark, sf), _weighted(spark, sf)).groupBy("cluster").agg(F.count("*").alias("n"))


@query("leiden_files")
def leiden_files(spark, sf):
    """Communities of the file graph of each cluster by a few rounds over all clusters at once, with their sizes."""
    side = lambda end: code_nodes(spark, sf).select(F.col("node_id").alias(end), F.col("rel_path").alias(f"{end}_path"), F.col("macro_cluster").alias(f"{end}_scope"))
    e = _weighted(spark, sf).join(side("source_id"), "source_id").join(side("target_id"), "target_id").where("source_id_scope = target_id_scope")
    pairs = e.select(F.col("source_id_scope").alias("scope"), F.col("source_id_path").alias("a"), F.col("target_id_path").alias("b"), "weight")
    return numbered(leiden(pairs, rounds=5, levels=2)).groupBy("scope", "number").agg(F.count("*").alias("n"))


@query("sized_pages")
def sized_pages(spark, sf):
    """Pages of 4 to 60 nodes inside each section."""
    return C.pages(code_nodes(spark, sf), _weighted(spark, sf), _macro(spark, sf)).groupBy("section", "page").agg(F.count("*").alias("n"))


_PLACED = "pl AS (SELECT node_id, macro_cluster AS section, coalesce(micro_cluster, 0) AS page FROM cn WHERE node_id NOT LIKE 'p:%0'), hb AS (SELECT node_id AS hub FROM cn WHERE node_id LIKE 'p:%0'), ar AS (SELECT source_id AS hub, target_id AS node_id FROM ce UNION ALL SELECT target_id, source_id FROM ce), vt AS (SELECT hub, section, page FROM ar JOIN hb USING (hub) JOIN pl USING (node_id))"


@query("hub_places", f"""{_W}, {_PLACED}, vs AS (SELECT hub, arg_max(section, (n, -section)) AS s FROM (SELECT hub, section, count(*) AS n FROM vt GROUP BY 1, 2) GROUP BY 1), ls AS (SELECT arg_max(section, (n, -section)) AS s FROM (SELECT section, count(*) AS n FROM pl GROUP BY 1)), hs AS (SELECT hub, coalesce(vs.s, ls.s) AS section FROM hb LEFT JOIN vs USING (hub), ls),
vp AS (SELECT hub, section, arg_max(page, (n, -page)) AS p FROM (SELECT hub, section, page, count(*) AS n FROM vt GROUP BY 1, 2, 3) GROUP BY 1, 2), lp AS (SELECT section, arg_max(page, (n, -page)) AS p FROM (SELECT section, page, count(*) AS n FROM pl GROUP BY 1, 2) GROUP BY 1)
SELECT hub AS node_id, section, coalesce(vp.p, lp.p) AS page FROM hs LEFT JOIN vp USING (hub, section) LEFT JOIN lp USING (section)""")
def hub_places(spark, sf):
    """Nodes whose number ends in 0 stand for hubs; the others are placed by their clusters."""
    n = code_nodes(spark, sf)
    hub = F.col("node_id").rlike("^p:.*0$")
    placed = n.where(~hub).select("node_id", F.col("macro_cluster").alias("section"), F.coalesce("micro_cluster", F.lit(0)).alias("page"))
    return C.hub_places(code_edges(spark, sf), placed, n.where(hub).select("node_id"))


@query("clustered_graph")
def clustered_graph(spark, sf):
    """The whole path: projection, sections, pages, hubs, children; sections and pages with their sizes."""
    n, e = code_nodes(spark, sf).where("symbol_type NOT LIKE '%doc%' AND symbol_type <> 'text_chunk'"), _weighted(spark, sf)
    hubs = written(G.hubs(n, e).select("node_id"), "hubs")
    return C.clustered(n, e, hubs).groupBy("section", "page").agg(F.count("*").alias("n"))


@query("persisted_clusters", f"{_W} SELECT node_id, CASE WHEN symbol_type = 'class' THEN macro_cluster ELSE -1 END AS macro_cluster, node_id LIKE 'p:%00' AND symbol_type = 'class' AS is_hub FROM cn")
def persisted_clusters(spark, sf):
    n = code_nodes(spark, sf)
    own = n.where("symbol_type = 'class'")
    placed = own.select("node_id", F.col("macro_cluster").alias("section"), F.lit(0).alias("page"))
    return C.persisted(n, placed, own.where("node_id LIKE 'p:%00'").select("node_id")).select("node_id", F.coalesce("macro_cluster", F.lit(-1)).alias("macro_cluster"), "is_hub")


@query("central_symbols")
def central_symbols(spark, sf):
    """The five most central symbols of each section."""
    return C.central_symbols(code_nodes(spark, sf), _weighted(spark, sf), "macro_cluster", 5)


@query("directory_clusters")
def directory_clusters(spark, sf):
    """Communities of the directory graph, as many as are nearest to twelve."""
    s = _symbols(spark, sf)
    coupled = G.contracted(code_nodes(spark, sf), code_edges(spark, sf), lambda p: F.regexp_replace(p, "/?[^/]*$", ""))
    return C.directory_communities(coupled, s.select("dir").distinct(), 12).groupBy("cluster").agg(F.count("*").alias("dirs"))


@query("directory_histogram", f"{_W} SELECT macro_cluster AS cluster, CASE WHEN {_DIR} = '' THEN '<root>' ELSE {_DIR} END AS dir, count(*) AS n FROM cn GROUP BY 1, 2")
def directory_histogram(spark, sf):
    d = F.regexp_replace("rel_path", "/?[^/]*$", "")
    return code_nodes(spark, sf).groupBy(F.col("macro_cluster").alias("cluster"), F.when(d == "", "<root>").otherwise(d).alias("dir")).agg(F.count("*").alias("n"))
