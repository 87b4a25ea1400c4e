"""Queries over the graph view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import expand as X
from graphloom.operators import graph as G
from graphloom.plans import jql
from graphloom.plans.registry import query
from graphloom.plans.views import GRAPH_SQL, edges, nodes, table

_W = f"WITH {GRAPH_SQL}"
_DEG = "deg AS (SELECT node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes LEFT JOIN (SELECT target_id, count(*) i FROM edges GROUP BY 1) a ON a.target_id = node_id LEFT JOIN (SELECT source_id, count(*) o FROM edges GROUP BY 1) b ON b.source_id = node_id)"
r6 = lambda c: F.round(c, 6)


@query("node_stats", f"{_W} SELECT symbol_type, count(*) AS n, count(DISTINCT rel_path) AS paths FROM nodes GROUP BY 1")
def node_stats(spark, sf):
    return nodes(spark, sf).groupBy("symbol_type").agg(F.count("*").alias("n"), F.countDistinct("rel_path").alias("paths"))


@query("edge_type_counts", f"{_W} SELECT rel_type, count(*) AS n FROM edges GROUP BY 1")
def edge_type_counts(spark, sf):
    return edges(spark, sf).groupBy("rel_type").agg(F.count("*").alias("n"))


@query("nodes_by_ids", f"{_W} SELECT * FROM nodes WHERE node_id IN ('r:0', 'n:3', 'c:7', 'p:11', 'x:1')")
def nodes_by_ids(spark, sf):
    return nodes(spark, sf).where(F.col("node_id").isin("r:0", "n:3", "c:7", "p:11", "x:1"))


@query("nodes_by_prefix", f"{_W} SELECT * FROM nodes WHERE rel_path LIKE 'src/part/1/%' OR rel_path = 'src/part/1'")
def nodes_by_prefix(spark, sf):
    return nodes(spark, sf).where(S.within(F.col("rel_path"), "src/part/1"))


@query("nodes_by_raw_prefix", f"{_W} SELECT node_id, rel_path FROM nodes WHERE starts_with(rel_path, 'src/p') ORDER BY node_id LIMIT 500")
def nodes_by_raw_prefix(spark, sf):
    return nodes(spark, sf).where(F.col("rel_path").startswith("src/p")).select("node_id", "rel_path").orderBy("node_id").limit(500)


@query("edges_from", f"{_W} SELECT * FROM edges WHERE source_id = 'o:1' OR (target_id = 'n:1' AND rel_type IN ('references', 'contains'))")
def edges_from(spark, sf):
    return edges(spark, sf).where((F.col("source_id") == "o:1") | ((F.col("target_id") == "n:1") & F.col("rel_type").isin("references", "contains")))


@query("degree", f"{_W}, {_DEG} SELECT * FROM deg")
def degree(spark, sf):
    return G.degrees(nodes(spark, sf), edges(spark, sf))


@query("edge_weights", f"{_W} SELECT source_id, target_id, rel_type, round(1 / ln(n + 2.0), 6) AS weight FROM edges JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) USING (target_id)")
def edge_weights(spark, sf):
    return G.edge_weights(edges(spark, sf)).withColumn("weight", r6("weight"))


@query("hubs", f"{_W}, {_DEG}, m AS (SELECT avg(in_degree) m, stddev_pop(in_degree) s FROM deg) SELECT node_id, in_degree, round((in_degree - m) / s, 6) AS z FROM deg, m WHERE (in_degree - m) / s > 3")
def hubs(spark, sf):
    return G.hubs(nodes(spark, sf), edges(spark, sf)).withColumn("z", r6("z"))


@query("orphans", f"{_W} SELECT * FROM nodes WHERE node_id NOT IN (SELECT source_id FROM edges WHERE rel_type = 'composition' UNION SELECT target_id FROM edges WHERE rel_type = 'composition')")
def orphans(spark, sf):
    return G.orphans(nodes(spark, sf), edges(spark, sf).where("rel_type = 'composition'"))


@query("has_rel_semi", f"{_W} SELECT * FROM nodes WHERE node_id IN (SELECT source_id FROM edges WHERE rel_type IN ('calls', 'contains') UNION SELECT target_id FROM edges WHERE rel_type IN ('calls', 'contains'))")
def has_rel(spark, sf):
    return G.having_relation(nodes(spark, sf), edges(spark, sf), ["calls", "contains"])


_BFS = """, hops AS (
  SELECT 'n:1' AS node_id, 0 AS hop UNION SELECT CASE WHEN e.source_id = h.node_id THEN e.target_id ELSE e.source_id END, hop + 1 FROM hops h JOIN edges e ON (e.source_id = h.node_id OR e.target_id = h.node_id) WHERE hop < 2)
SELECT node_id, min(hop) AS hop FROM hops GROUP BY 1"""


@query("neighbors_khop", f"WITH RECURSIVE {GRAPH_SQL}{_BFS}")
def neighbors_khop(spark, sf):
    return G.within_hops(edges(spark, sf), spark.sql("SELECT 'n:1' AS node_id"), 2)


@query("neighbors_1hop", f"{_W} SELECT DISTINCT target_id AS node_id, rel_type FROM edges WHERE source_id = 'o:1' UNION SELECT source_id, rel_type FROM edges WHERE target_id = 'o:1'")
def neighbors_1hop(spark, sf):
    e = edges(spark, sf)
    return e.where("source_id = 'o:1'").select(F.col("target_id").alias("node_id"), "rel_type").union(e.where("target_id = 'o:1'").select("source_id", "rel_type")).distinct()


@query("shortest_path_len", f"WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT 'o:1' AS node_id, 0 AS hop UNION SELECT e.target_id, hop + 1 FROM walk w JOIN edges e ON e.source_id = w.node_id WHERE hop < 5) SELECT node_id AS target, min(hop) AS length FROM walk WHERE node_id LIKE 'r:%' OR node_id LIKE 'n:%' GROUP BY 1")
def shortest_path(spark, sf):
    """Directed distances from one order to the regions and nations it reaches."""
    found = G.within_hops(edges(spark, sf), spark.sql("SELECT 'o:1' AS node_id"), 5, "out")
    return found.where("node_id LIKE 'r:%' OR node_id LIKE 'n:%'").select(F.col("node_id").alias("target"), F.col("hop").alias("length"))


def _sparse(e):
    """A sparser graph, with many components: calls of the orders."""
    return e.where("rel_type IN ('calls', 'contains')")


@query("components", f"{_W}, s AS (SELECT * FROM edges WHERE rel_type IN ('calls', 'contains')) SELECT node_id, coalesce(CASE WHEN node_id LIKE 'o:%' THEN (least(node_id, first)) WHEN node_id LIKE 'c:%' THEN least(node_id, coalesce(first, node_id)) ELSE first END, node_id) AS component FROM (SELECT node_id, coalesce(a.first, b.first, c.first, d.first) AS first FROM nodes LEFT JOIN (SELECT s1.source_id AS x, min(least(s1.target_id, s2.source_id)) AS first FROM s s1 JOIN s s2 USING (target_id) WHERE s1.rel_type = 'calls' GROUP BY 1) a ON a.x = node_id LEFT JOIN (SELECT target_id AS x, min(source_id) AS first FROM s WHERE rel_type = 'calls' GROUP BY 1) b ON b.x = node_id LEFT JOIN (SELECT s1.source_id AS x, min(least(s1.target_id, s2.source_id)) AS first FROM s s1 JOIN s s2 USING (target_id) WHERE s1.rel_type = 'contains' GROUP BY 1) c ON c.x = node_id LEFT JOIN (SELECT target_id AS x, min(least(source_id, target_id)) AS first FROM s WHERE rel_type = 'contains' GROUP BY 1) d ON d.x = node_id)")
def components(spark, sf):
    return G.weak_components(nodes(spark, sf), _sparse(edges(spark, sf)))


_PR = f"""{_W}, und AS (SELECT least(source_id, target_id) a, greatest(source_id, target_id) b, count(*) w FROM edges GROUP BY 1, 2),
arcs AS (SELECT a u, b v, w FROM und UNION ALL SELECT b, a, w FROM und WHERE a <> b), tot AS (SELECT u, sum(w) t FROM arcs GROUP BY 1), sh AS (SELECT u, v, w / t AS s FROM arcs JOIN tot USING (u)),
n AS (SELECT count(*)::DOUBLE n FROM nodes), r0 AS (SELECT node_id, 1 / n AS r FROM nodes, n)""" + "".join(
    f", l{i} AS (SELECT coalesce(sum(r), 0) l FROM r{i} WHERE node_id NOT IN (SELECT u FROM tot)), g{i} AS (SELECT v, sum(r * s) g FROM sh JOIN r{i} ON u = node_id GROUP BY 1), r{i + 1} AS (SELECT node_id, 0.15 / n + 0.85 * (coalesce(g, 0) + l / n) AS r FROM nodes LEFT JOIN g{i} ON v = node_id, n, l{i})"
    for i in range(3)
) + " SELECT node_id, round(r * 1000, 6) AS rank FROM r3"


@query("pagerank_k_iters", _PR)
def pagerank(spark, sf):
    return G.pagerank(nodes(spark, sf), edges(spark, sf), 3).select("node_id", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query("undirected_collapse", f"{_W} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS weight FROM edges GROUP BY 1, 2")
def undirected(spark, sf):
    return G.undirected(edges(spark, sf))


_CONTRACT = "SELECT least(a.g, b.g) AS a, greatest(a.g, b.g) AS b, count(*) AS weight FROM edges JOIN g a ON a.node_id = source_id JOIN g b ON b.node_id = target_id WHERE a.g <> b.g GROUP BY 1, 2"


@query("file_contraction", f"{_W}, g AS (SELECT node_id, regexp_replace(rel_path, '/?[^/]*$', '') AS g FROM nodes) {_CONTRACT}")
def file_contraction(spark, sf):
    return G.contracted(nodes(spark, sf), edges(spark, sf), S.directory)


@query("dir_interaction", f"{_W}, g AS (SELECT node_id, split_part(rel_path, '/', 2) AS g FROM nodes) {_CONTRACT}")
def dir_interaction(spark, sf):
    return G.contracted(nodes(spark, sf), edges(spark, sf), lambda p: F.split(p, "/")[1])


@query("dir_histogram", f"{_W} SELECT symbol_type, regexp_replace(rel_path, '/?[^/]*$', '') AS dir, count(*) AS n FROM nodes GROUP BY 1, 2")
def dir_histogram(spark, sf):
    return nodes(spark, sf).groupBy("symbol_type", S.directory(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("n"))


@query("dir_similarity", f"{_W}, h AS (SELECT symbol_type AS t, split_part(rel_path, '/', 3) AS d, count(*) AS n FROM nodes GROUP BY 1, 2) SELECT a.t AS a, b.t AS b, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM h a JOIN h b ON a.d = b.d AND a.t < b.t GROUP BY 1, 2")
def dir_similarity(spark, sf):
    """Multiset intersection of directory histograms."""
    h = nodes(spark, sf).groupBy(F.col("symbol_type").alias("t"), F.split("rel_path", "/")[2].alias("d")).agg(F.count("*").alias("n"))
    a, b = (h.select(F.col("t").alias(x), "d", F.col("n").alias(f"n{x}")) for x in "ab")
    return a.join(b, "d").where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("shared"))


@query("effective_depth", f"{_W}, d AS (SELECT len(string_split(rel_path, '/')) - 1 AS depth, row_number() OVER (ORDER BY len(string_split(rel_path, '/'))) - 1 AS i, count(*) OVER () AS n FROM nodes) SELECT CAST(greatest(5, least(8, depth + 1)) AS INT) AS depth FROM d WHERE i = floor(0.9 * n)")
def effective_depth(spark, sf):
    """The 90th percentile of directory depth, plus one, within 5 and 8; from the histogram of depths."""
    hist = nodes(spark, sf).groupBy((F.size(F.split("rel_path", "/")) - 1).alias("depth")).count()
    upto = hist.withColumn("below", F.sum("count").over(Window.orderBy("depth"))).withColumn("n", F.sum("count").over(Window.partitionBy()))
    return upto.where(F.col("below") > F.floor(0.9 * F.col("n"))).agg(F.greatest(F.lit(5), F.least(F.lit(8), F.min("depth") + 1)).alias("depth"))


@query("alias_chain", "WITH RECURSIVE step AS (SELECT o_orderkey AS s, o_orderkey // 7 AS t FROM orders WHERE o_orderkey % 3 = 0), walk AS (SELECT s, t, 1 AS hops FROM step UNION ALL SELECT w.s, step.t, hops + 1 FROM walk w JOIN step ON step.s = w.t WHERE hops < 5) SELECT 'o:' || s AS source_id, 'o:' || arg_max(t, hops) AS resolved, max(hops) AS hops FROM walk GROUP BY s")
def alias_chain(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("o:"), F.floor(F.col("o_orderkey") / 7).cast("string")).alias("target_id"))
    return G.alias_targets(o, 5)


@query("alias_chain_all", "WITH RECURSIVE step AS (SELECT o_orderkey AS s, o_orderkey // 7 AS t FROM orders), walk AS (SELECT s, t, 1 AS hops FROM step UNION ALL SELECT w.s, step.t, hops + 1 FROM walk w JOIN step ON step.s = w.t WHERE hops < 5) SELECT 'o:' || s AS source_id, 'o:' || arg_max(t, hops) AS resolved, max(hops) AS hops FROM walk GROUP BY s")
def alias_chain_all(spark, sf):
    """The same over the alias steps of all orders."""
    key = F.col("o_orderkey")
    return G.alias_targets(table(spark, sf, "orders").select(F.concat(F.lit("o:"), key.cast("string")).alias("source_id"), F.concat(F.lit("o:"), F.floor(key / 7).cast("string")).alias("target_id")), 5)


@query("nearest_ancestor_anchor", f"""{_W}, d AS (SELECT n.node_id, rel_path, (SELECT count(*) FROM orders WHERE 'c:' || o_custkey = n.node_id AND o_orderkey % 20 = 0) AS degree FROM nodes n WHERE symbol_type = 'customer'),
p AS (SELECT node_id, degree, 0 AS depth, regexp_replace(rel_path, '/?[^/]*$', '') AS dir FROM d UNION ALL SELECT node_id, degree, 1, 'src/customer' FROM d UNION ALL SELECT node_id, degree, 2, 'src' FROM d UNION ALL SELECT node_id, degree, 3, '' FROM d),
best AS (SELECT dir, arg_max(node_id, (degree, node_id)) AS anchor FROM p WHERE degree > 0 GROUP BY 1)
SELECT p.node_id AS orphan, arg_min(anchor, depth) AS anchor, CAST(min(depth) AS INT) AS depth FROM p JOIN best USING (dir) WHERE degree = 0 GROUP BY 1""")
def nearest_anchor(spark, sf):
    n = nodes(spark, sf).where("symbol_type = 'customer'")
    calls = table(spark, sf, "orders").where("o_orderkey % 20 = 0")
    return G.nearest_anchor(n, calls.select(F.lit("").alias("source_id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("target_id")))


@query("nearest_ancestor_anchor_all", f"""{_W}, {_DEG}, d AS (SELECT node_id, regexp_replace(rel_path, '/?[^/]*$', '') AS dir, in_degree + out_degree AS degree FROM nodes JOIN deg USING (node_id)),
p AS (SELECT node_id, degree, 0 AS depth, dir FROM d UNION ALL SELECT node_id, degree, 1, regexp_replace(dir, '/[^/]*$', '') FROM d UNION ALL SELECT node_id, degree, 2, 'src' FROM d UNION ALL SELECT node_id, degree, 3, '' FROM d),
best AS (SELECT dir, arg_max(node_id, (degree, node_id)) AS anchor FROM p WHERE degree > 0 GROUP BY 1)
SELECT p.node_id AS orphan, arg_min(anchor, depth) AS anchor, CAST(min(depth) AS INT) AS depth FROM p JOIN best USING (dir) WHERE degree = 0 GROUP BY 1""")
def nearest_anchor_all(spark, sf):
    """The same over all nodes and edges."""
    return G.nearest_anchor(nodes(spark, sf), edges(spark, sf))


_PRI = "CASE symbol_type WHEN 'region' THEN 10 WHEN 'nation' THEN 8 WHEN 'supplier' THEN 6 WHEN 'part' THEN 3 ELSE 1 END"


@query("centroids", f"""{_W}, {_DEG}, x AS (SELECT node_id, split_part(rel_path, '/', 3) AS page, {_PRI} AS pri, in_degree + out_degree AS deg FROM nodes JOIN deg USING (node_id)),
y AS (SELECT *, count(*) OVER w AS n, 0.6::DOUBLE * deg / greatest(max(deg) OVER w, 1) + 0.4::DOUBLE * pri / greatest(max(pri) OVER w, 1) AS s FROM x WINDOW w AS (PARTITION BY page)),
z AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s DESC, node_id) AS rank FROM y)
SELECT page, node_id, CAST(rank AS INT) AS rank, round(s / max(s) OVER (PARTITION BY page), 6) AS score FROM z WHERE rank <= greatest(1, least(10, round_even(sqrt(n), 0)))""")
def centroids(spark, sf):
    pri = F.expr(_PRI)
    return G.centroids(nodes(spark, sf), edges(spark, sf), F.split("rel_path", "/")[2], pri).withColumn("score", r6("score"))


@query("hub_reintegrate", f"""{_W}, v AS (SELECT hub, c, count(*) AS n FROM (SELECT source_id AS hub, target_id AS o FROM edges UNION ALL SELECT target_id, source_id FROM edges) JOIN (SELECT node_id, CAST(split_part(rel_path, '/', 3) AS INT) AS c FROM nodes) ON node_id = o WHERE hub LIKE 'n:%' OR hub LIKE 'r:%' GROUP BY 1, 2)
SELECT hub, arg_max(c, (n, -c)) AS cluster, max(n) AS votes FROM v GROUP BY 1""")
def hub_reintegrate(spark, sf):
    n = nodes(spark, sf)
    clusters = n.select("node_id", F.split("rel_path", "/")[2].cast("int").alias("cluster"))
    return G.hub_votes(edges(spark, sf), clusters, n.where("symbol_type IN ('nation', 'region')"))


_JD = f"{_W}, {_DEG}, j AS (SELECT node_id, symbol_name, symbol_type, rel_path, in_degree + out_degree AS connections FROM nodes JOIN deg USING (node_id))"


def _jql(name: str, text: str, where: str, limit: int = 20):
    @query(name, f"{_JD} SELECT * FROM j WHERE {where} ORDER BY connections DESC, node_id LIMIT {limit}")
    def run(spark, sf):
        return jql.compile_jql(text, nodes(spark, sf), edges(spark, sf))


_jql("jql_type_path", "type:part file:src/part/1 limit:50", "symbol_type = 'part' AND rel_path LIKE 'src/part/1/%'", 50)
_jql("jql_name_glob", 'type:customer name:"Customer#*7"', "symbol_type = 'customer' AND lower(symbol_name) LIKE 'customer#%7'")
_jql("jql_has_rel", "has_rel:call type:customer", "symbol_type = 'customer' AND node_id IN (SELECT source_id FROM edges WHERE rel_type = 'calls' UNION SELECT target_id FROM edges WHERE rel_type = 'calls')")
_jql("jql_connections", "type:part connections:>=20 limit:500", "symbol_type = 'part' AND connections >= 20", 500)
_jql("jql_or", "type:region OR type:nation limit:100", "symbol_type IN ('region', 'nation')", 100)
_jql("jql_not", "type:!=orders type:!=part connections:>1", "symbol_type NOT IN ('orders', 'part') AND connections > 1")
_jql("jql_text", "text:order file:src/orders/3/*", "contains(lower(symbol_name), 'order') AND rel_path LIKE 'src/orders/3/%'")
_jql("jql_related", "related:EUROPE dir:in type:supplier limit:30", "symbol_type = 'supplier' AND node_id IN (SELECT s.source_id FROM edges s JOIN edges n ON s.target_id = n.source_id JOIN nodes r ON r.node_id = n.target_id WHERE lower(r.symbol_name) = 'europe')", 30)


@query("nl_to_jql", f"{_JD} SELECT * FROM j WHERE symbol_type = 'supplier' AND rel_path LIKE 'src/supplier/2/%' ORDER BY connections DESC, node_id LIMIT 20")
def nl_to_jql(spark, sf):
    return jql.compile_jql(jql.from_question("Show all suppliers in src/supplier/2/"), nodes(spark, sf), edges(spark, sf))


_AS_CODE = "CASE symbol_type WHEN 'customer' THEN 'class' WHEN 'part' THEN 'function' WHEN 'supplier' THEN 'constant' ELSE symbol_type END"


@query("expand_rules", f"""{_W}, w AS (SELECT source_id, target_id, rel_type, round(1 / ln(n + 2.0), 9) AS weight FROM edges JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) USING (target_id)),
seeds AS (SELECT node_id, {_AS_CODE} AS t FROM nodes WHERE symbol_type IN ('customer', 'part', 'supplier')),
rules AS (SELECT * FROM (VALUES ('class', 'out', 'references', 2, 'refs'), ('function', 'out', 'composition', 2, 'refs'), ('constant', 'out', 'references', 2, 'type')) AS v(t, d, rel, most, reason)),
f AS (SELECT s.node_id AS seed, w.target_id AS other, reason, weight, most, row_number() OVER (PARTITION BY s.node_id, reason ORDER BY weight DESC, target_id) AS r FROM seeds s JOIN rules USING (t) JOIN w ON w.source_id = s.node_id AND w.rel_type = rel)
SELECT seed, other, reason, CAST(row_number() OVER (PARTITION BY seed ORDER BY weight DESC, other, reason) AS INT) AS rank FROM f WHERE r <= most""")
def expand_rules(spark, sf):
    seeds = nodes(spark, sf).where("symbol_type IN ('customer', 'part', 'supplier')").select("node_id", F.expr(_AS_CODE).alias("symbol_type"))
    weighted = G.edge_weights(edges(spark, sf)).withColumn("weight", F.round("weight", 9))
    return X.expanded(seeds, weighted, X.RULES)


@query("expand_two_hop", f"{_W} SELECT a.source_id AS start, count(*) AS ends, string_agg(b.target_id, ',' ORDER BY b.target_id) AS joined FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE rel_type = 'calls') a JOIN edges b ON a.target_id = b.source_id AND b.rel_type = 'references' GROUP BY 1")
def expand_two_hop(spark, sf):
    pairs = X.two_hops(edges(spark, sf), "calls", "references")
    return pairs.groupBy("start").agg(F.count("*").alias("ends"), F.array_join(F.array_sort(F.collect_list("end")), ",").alias("joined"))


@query("louvain")
def louvain(spark, sf):
    """Communities of the graph of directories (contracted first, so its size is that of the directory tree)."""
    return X.communities(G.contracted(nodes(spark, sf), edges(spark, sf), S.directory).withColumn("scope", F.lit("all")), "scope")


@query("edge_weight_stats", f"{_W} SELECT rel_type, count(*) AS n, round(avg(w), 6) AS mean, round(min(w), 6) AS least, round(max(w), 6) AS most FROM (SELECT rel_type, 1 / ln(n + 2.0) AS w FROM edges JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) USING (target_id)) GROUP BY 1")
def edge_weight_stats(spark, sf):
    return G.edge_weights(edges(spark, sf)).groupBy("rel_type").agg(F.count("*").alias("n"), r6(F.avg("weight")).alias("mean"), r6(F.min("weight")).alias("least"), r6(F.max("weight")).alias("most"))
