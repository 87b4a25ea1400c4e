"""Queries that look for symbols: by full text, by name, by relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import fts
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.plans.code_queries import _ARCH, _DOCT, _LAYER, _PRIO
from graphloom.plans.code_view import CODE_SQL, code_edges, code_nodes
from graphloom.plans.registry import query
from graphloom.plans.views import table

_W = f"WITH {CODE_SQL}"
r6 = lambda c: F.round(c, 6)
_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_NAMET = r"trim(lower(regexp_replace(regexp_replace(regexp_replace(symbol_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
_TK = "tc AS (" + " UNION ALL ".join(f"SELECT node_id, '{c}' AS col, {_WORDS.format(e)} AS t FROM cn" for c, e in (("symbol_name", "symbol_name"), ("name_tokens", _NAMET), ("docstring", "docstring"), ("content", "source_text"))) + "), tk AS (SELECT node_id, col, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM tc), ln AS (SELECT node_id, sum(len(t)) AS dl FROM tc GROUP BY 1), sx AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM ln)"
_CW = "CASE {}.col WHEN 'symbol_name' THEN 10.0 WHEN 'name_tokens' THEN 8.0 WHEN 'docstring' THEN 3.0 ELSE 1.0 END"


def _fts_sql(q: fts.Query, where: str = "true", k: int = 10, plain: bool = False) -> str:
    """The search written out as joins of tokens; ends in a table ``hit`` of node_id and score."""
    phrases = list(dict.fromkeys(p for group in q for p in group))
    parts = []
    for i, p in enumerate(phrases):
        match = lambda a, w, last: f"starts_with({a}.term, '{w}')" if last and p.prefix else f"{a}.term = '{w}'"  # noqa: B023, E731
        joins = "".join(f" JOIN tk t{j} ON t{j}.node_id = t0.node_id AND t{j}.col = t0.col AND t{j}.pos = t0.pos + {j} AND {match(f't{j}', w, j == len(p.words) - 1)}" for j, w in enumerate(p.words) if j)
        col = f" AND t0.col = '{p.column}'" if p.column else ""
        weight = "1.0" if plain else _CW.format("t0")
        times = sum(group.count(p) for group in q)
        parts.append(f"SELECT {i} AS q, {times} AS times, t0.node_id, sum({weight})::DOUBLE AS f FROM tk t0{joins} WHERE {match('t0', p.words[0], len(p.words) == 1)}{col} GROUP BY t0.node_id")
    holds = " OR ".join("(" + " AND ".join(f"list_contains(qs, {phrases.index(p)})" for p in group) + ")" for group in q)
    return f"""{_TK}, ph AS ({' UNION ALL '.join(parts)}), dfs AS (SELECT q, count(*) AS df FROM ph GROUP BY 1),
sc AS (SELECT node_id, sum(times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, list(q) AS qs FROM ph JOIN dfs USING (q) JOIN ln USING (node_id), sx GROUP BY 1),
hit AS (SELECT node_id, score FROM sc JOIN cn USING (node_id) WHERE ({holds}) AND ({where}) ORDER BY score DESC, node_id LIMIT {k})"""


def index(spark, sf):
    return fts.kept(spark, "symbols", [f"{sf}/{t}.parquet" for t in ("part", "supplier", "documents")], lambda: fts.build(code_nodes(spark, sf), "node_id", fts.symbol_columns(code_nodes(spark, sf))))


def _search(name: str, q: fts.Query, where: str = "true", k: int = 10, among=None, plain: bool = False):
    @query(name, f"{_W}, {_fts_sql(q, where, k, plain)} SELECT node_id, round(score, 6) AS score FROM hit")
    def run(spark, sf):
        kept = among(code_nodes(spark, sf)) if among else None
        return fts.search(index(spark, sf), q, None if plain else fts.SYMBOL_WEIGHTS, k, kept).withColumn("score", r6("score"))

    return run


@query("fts_postings", f"{_W}, {_TK} SELECT term, col, count(DISTINCT node_id) AS df, count(*) AS places FROM tk GROUP BY 1, 2")
def fts_postings(spark, sf):
    return index(spark, sf).postings.groupBy("term", "col").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("places"))


@query("okapi_postings", "WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS places FROM t GROUP BY 1")
def okapi_postings(spark, sf):
    own = fts.kept(spark, "okapi", [f"{sf}/documents.parquet"], lambda: fts.text_index(table(spark, sf, "documents")))
    return own.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("places"))


_search("fts_symbols", fts.prepared("redBolt widget"), "symbol_type IN ('class', 'function', 'interface') AND symbol_type NOT IN ('function') AND language = 'python'", 10, lambda n: n.where("symbol_type IN ('class', 'interface') AND language = 'python'"))
_search("fts_smart_general", fts.from_question("How does the economy anvil work?"), k=20)
_search("fts_smart_concept", fts.from_question("small gizmo kind", "concept"), k=20)
_search("fts_smart_symbol", fts.from_question("SmallGizmo30", "symbol"), k=20)
_search("fts_smart_doc", fts.from_question("Handles every old ring", "doc"), k=20)
_search("fts_symbol_and_concept", fts.symbols_and_concepts(["BlueGear4"], ["promo"]), k=15)
_search("fts_phrase_column", fts.phrase_query("of the economy kind", "docstring"), k=25)
_search("fts_all_words", [[fts.phrase("apache"), fts.phrase("license")]], "symbol_type IN ('markdown_document', 'text_chunk')", 10, lambda n: n.where("symbol_type IN ('markdown_document', 'text_chunk')"), True)
_search("fts_path_and_cluster", [[fts.phrase("bolt")]], "starts_with(rel_path, 'src/small/') AND macro_cluster = 3", 10, lambda n: n.where("rel_path LIKE 'src/small/%' AND macro_cluster = 3"), True)
_search("fts_any_word", [[fts.phrase(w)] for w in ("license", "bolt")], "symbol_type NOT IN ('module_doc', 'file_doc', 'readme')", 10, lambda n: n.where("symbol_type NOT IN ('module_doc', 'file_doc', 'readme')"), True)
_search("fts_exact_name", [[fts.phrase("SmallGizmo30", False, "symbol_name")]], _ARCH, 3, lambda n: n.where(S.is_architectural_type(F.col("symbol_type"))), True)

_OVER = fts.from_question("small gizmo kind", "concept")


@query("fts_symbols_post_path", f"{_W}, {_fts_sql(_OVER, k=60)} SELECT node_id, round(score, 6) AS score FROM hit JOIN cn USING (node_id) WHERE starts_with(rel_path, 'src/small') ORDER BY hit.score DESC, node_id LIMIT 20")
def fts_symbols_post_path(spark, sf):
    """Three times as many are fetched, then filtered by path."""
    hits = fts.search(index(spark, sf), _OVER, fts.SYMBOL_WEIGHTS, 60)
    own = hits.join(code_nodes(spark, sf).where("rel_path LIKE 'src/small%'").select("node_id"), "node_id", "left_semi")
    return own.orderBy(F.desc("score"), "node_id").limit(20).withColumn("score", r6("score"))


_SVC = fts.from_question("Which small widgets are there?")


@query("service_search", f"{_W}, dgr AS (SELECT node_id, count(*) AS c FROM (SELECT source_id AS node_id FROM ce UNION ALL SELECT target_id FROM ce) GROUP BY 1), {_fts_sql(_SVC, k=60)} SELECT node_id, round(score, 6) AS score, coalesce(c, 0) AS connections FROM hit JOIN cn USING (node_id) LEFT JOIN dgr USING (node_id) WHERE {_LAYER} = 'public_api' AND starts_with(rel_path, 'src/') ORDER BY hit.score DESC, node_id LIMIT 20")
def service_search(spark, sf):
    """Three times as many are fetched, filtered by layer and path, and given their degree."""
    n = code_nodes(spark, sf)
    own = n.where((S.layer(F.col("symbol_name"), F.col("symbol_type"), F.col("rel_path"), F.col("parent_symbol")) == "public_api") & S.within(F.col("rel_path"), "src")).select("node_id")
    hits = fts.search(index(spark, sf), _SVC, fts.SYMBOL_WEIGHTS, 60).join(own, "node_id", "left_semi")
    ends = code_edges(spark, sf).select(F.explode(F.array("source_id", "target_id")).alias("node_id")).join(F.broadcast(hits.select("node_id")), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("connections"))
    return hits.join(ends, "node_id", "left").orderBy(F.desc("score"), "node_id").limit(20).select("node_id", r6("score").alias("score"), F.coalesce("connections", F.lit(0)).alias("connections"))


_DG = "dgr AS (SELECT node_id, coalesce(c, 0) AS connections FROM cn LEFT JOIN (SELECT node_id, count(*) AS c FROM (SELECT source_id AS node_id FROM ce UNION ALL SELECT target_id FROM ce) GROUP BY 1) USING (node_id))"
_SCORE = "CASE WHEN lower(symbol_name) = 'red bolt' THEN 100.0 WHEN contains(lower(symbol_name), 'red bolt') THEN 50.0 WHEN contains(lower(symbol_name), 'red') OR contains(lower(symbol_name), 'bolt') THEN 10.0 * (contains(lower(symbol_name), 'red')::INT + contains(lower(symbol_name), 'bolt')::INT) ELSE 3.0 * (contains(lower(docstring), 'red')::INT + contains(lower(docstring), 'bolt')::INT) END"


@query("scan_search", f"{_W}, {_DG} SELECT node_id, ({_SCORE})::DOUBLE AS score, connections FROM cn JOIN dgr USING (node_id) WHERE {_SCORE} > 0 ORDER BY score DESC, connections DESC, node_id LIMIT 20")
def scan_search(spark, sf):
    n = code_nodes(spark, sf)
    return R.scanned(n, G.degrees(n, code_edges(spark, sf)), "red bolt")


_BASE = "(CASE WHEN lower(symbol_name) = 'old ring' THEN 100.0 WHEN contains(lower(symbol_name), 'old ring') THEN 50.0 ELSE 0.0 END + 10.0 * (contains(lower(symbol_name), 'old')::INT + contains(lower(symbol_name), 'ring')::INT) + 3.0 * (contains(lower(docstring), 'old')::INT + contains(lower(docstring), 'ring')::INT))"
_BODY = "(contains(lower(substr(source_text, 1, 2000)), 'old')::INT + contains(lower(substr(source_text, 1, 2000)), 'ring')::INT)"


@query("scan_search_content", f"{_W}, {_DG}, s AS (SELECT node_id, (CASE WHEN {_BASE} < 20 THEN {_BASE} + {_BODY} ELSE {_BASE} END)::DOUBLE AS score FROM cn WHERE NOT {_DOCT}) SELECT node_id, score, connections FROM s JOIN dgr USING (node_id) WHERE score > 0 ORDER BY score DESC, connections DESC, node_id LIMIT 10")
def scan_search_content(spark, sf):
    n = code_nodes(spark, sf)
    return R.scanned(n, G.degrees(n, code_edges(spark, sf)), "old ring", 10, True)


_ASK = """nq AS (SELECT DISTINCT * FROM (SELECT symbol_name AS name, rel_path AS file, language AS lang FROM cn WHERE symbol_type IN ('class', 'struct') UNION ALL SELECT 'pkg.' || symbol_name, rel_path, language FROM cn WHERE symbol_type = 'enum'
 UNION ALL SELECT symbol_name, '', language FROM cn WHERE symbol_type = 'trait' UNION ALL SELECT symbol_name, 'src/small', '' FROM cn WHERE symbol_type = 'macro' UNION ALL SELECT 'absent', '', ''))"""
_BEST = f"row_number() OVER (PARTITION BY {{}} ORDER BY {_PRIO} DESC, node_id) = 1"
_RES = f"""xk AS (SELECT symbol_name AS name, rel_path AS file, language AS lang, node_id FROM cn QUALIFY {_BEST.format('symbol_name, rel_path, language')}), fk AS (SELECT symbol_name AS name, node_id FROM cn QUALIFY {_BEST.format('symbol_name')}),
al AS (SELECT q.*, x.node_id, 1 AS tier FROM nq q JOIN xk x USING (name, file, lang) UNION ALL SELECT q.*, x.node_id, 2 FROM nq q JOIN xk x ON x.name = regexp_extract(q.name, '([^.]*)$', 1) AND x.file = q.file AND x.lang = q.lang WHERE contains(q.name, '.') UNION ALL SELECT q.*, f.node_id, 3 FROM nq q JOIN fk f USING (name))"""


def _asked(spark, sf):
    n = code_nodes(spark, sf)
    as_ = lambda df, name, file, lang: df.select(name.alias("name"), file.alias("file"), lang.alias("language"))
    name, path, lang, none = F.col("symbol_name"), F.col("rel_path"), F.col("language"), F.lit("")
    rows = as_(n.where("symbol_type IN ('class', 'struct')"), name, path, lang).union(as_(n.where("symbol_type = 'enum'"), F.concat(F.lit("pkg."), name), path, lang))
    rows = rows.union(as_(n.where("symbol_type = 'trait'"), name, none, lang)).union(as_(n.where("symbol_type = 'macro'"), name, F.lit("src/small"), none))
    return rows.union(as_(spark.range(1), F.lit("absent"), none, none))


@query("resolve_symbols", f"{_W}, {_ASK}, {_RES} SELECT name, file, lang, arg_min(node_id, tier) AS node_id, CAST(coalesce(min(tier), 0) AS INT) AS tier FROM nq LEFT JOIN al USING (name, file, lang) GROUP BY 1, 2, 3")
def resolve_symbols(spark, sf):
    return R.resolved(_asked(spark, sf), code_nodes(spark, sf)).withColumn("tier", F.coalesce("tier", F.lit(0)))


@query("best_nodes_by_name", f"{_W} SELECT symbol_name, node_id FROM cn QUALIFY {_BEST.format('symbol_name')}")
def best_nodes_by_name(spark, sf):
    return R.best_by(code_nodes(spark, sf), "symbol_name")


_REL = """hp AS (SELECT DISTINCT source_id, target_id, rel_type, 1 AS hop, CASE WHEN source_id = 'p:7' THEN target_id ELSE source_id END AS other FROM ce WHERE source_id = 'p:7' OR target_id = 'p:7'),
h2 AS (SELECT source_id, target_id, rel_type, 1 AS hop FROM hp UNION ALL SELECT DISTINCT e.source_id, e.target_id, e.rel_type, 2 FROM ce e JOIN (SELECT DISTINCT other FROM hp WHERE other <> 'p:7') o ON e.source_id = o.other OR e.target_id = o.other)"""


@query("typed_relationships", f"{_W}, {_REL} SELECT 'p:7' AS start, source_id, target_id, rel_type, CAST(min(hop) AS INT) AS hop FROM h2 GROUP BY ALL ORDER BY min(hop), source_id, target_id, rel_type LIMIT 50")
def typed_relationships(spark, sf):
    return R.relationships(code_edges(spark, sf), spark.sql("SELECT 'p:7' AS node_id"))


@query("resolve_and_traverse", f"{_W}, st AS (SELECT node_id AS start FROM cn WHERE symbol_name = 'SmallGizmo30' ORDER BY {_PRIO} DESC, node_id LIMIT 1), o AS (SELECT DISTINCT start, e.source_id, e.target_id, e.rel_type FROM ce e JOIN st ON e.source_id = start) SELECT start, source_id, target_id, rel_type, 1 AS hop FROM o QUALIFY row_number() OVER (ORDER BY source_id, target_id, rel_type) <= 50")
def resolve_and_traverse(spark, sf):
    """A name to its node, then the node's outgoing relations."""
    asked = spark.sql("SELECT 'SmallGizmo30' AS name, '' AS file, '' AS language")
    found = R.resolved(asked, code_nodes(spark, sf)).where("node_id IS NOT NULL").select("node_id")
    return R.relationships(code_edges(spark, sf), found, "outgoing", 1)


@query("edges_with_nodes", f"{_W} SELECT e.source_id, e.target_id, count(*) AS n, min(c.symbol_name) AS name FROM ce e JOIN cn c ON c.node_id = e.source_id WHERE e.rel_type = 'defines' AND c.symbol_type = 'class' GROUP BY 1, 2")
def edges_with_nodes(spark, sf):
    own = code_nodes(spark, sf).where("symbol_type = 'class'").select(F.col("node_id").alias("source_id"), "symbol_name")
    return code_edges(spark, sf).where("rel_type = 'defines'").join(own, "source_id").groupBy("source_id", "target_id").agg(F.count("*").alias("n"), F.min("symbol_name").alias("name"))


@query("typed_neighbours", f"{_W} SELECT source_id AS node_id, target_id AS other FROM (SELECT DISTINCT source_id, target_id FROM ce WHERE rel_type IN ('calls', 'references')) JOIN cn ON node_id = target_id WHERE symbol_type IN ('class', 'function') QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY target_id) <= 3")
def typed_neighbours(spark, sf):
    return R.neighbours(code_edges(spark, sf), code_nodes(spark, sf), ("calls", "references"), "successors", 3, ("class", "function"))


def _through(name: str, via: tuple[str, ...], second: tuple[str, ...], most: int):
    q = lambda xs: ", ".join(f"'{x}'" for x in xs)

    @query(name, f"{_W}, m AS (SELECT DISTINCT e.source_id AS node_id, e.target_id AS via FROM ce e JOIN cn c ON c.node_id = e.target_id WHERE rel_type = 'defines' AND symbol_type IN ({q(via)})), o AS (SELECT DISTINCT source_id AS via, target_id AS other FROM ce WHERE rel_type IN ({q(second)})) SELECT node_id, other FROM (SELECT DISTINCT node_id, other FROM m JOIN o USING (via) WHERE node_id <> other) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY other) <= {most}")
    def run(spark, sf):
        return R.through(code_edges(spark, sf), code_nodes(spark, sf), ("defines",), via, second, most)


_through("created_by_members", ("method", "constructor", "function"), ("creates", "calls"), 4)
_through("composed_types", ("constant", "field", "variable", "property"), ("composition", "aggregation"), 5)


@query("members_in_other_files", f"{_W}, m AS (SELECT DISTINCT source_id, target_id FROM ce WHERE rel_type = 'defines') SELECT o.node_id, c.rel_path AS file, string_agg(c.source_text, chr(10) || chr(10) ORDER BY c.start_line, c.node_id) AS body FROM m JOIN cn o ON o.node_id = source_id JOIN cn c ON c.node_id = target_id WHERE c.rel_path <> o.rel_path GROUP BY 1, 2")
def members_in_other_files(spark, sf):
    return R.members_elsewhere(code_nodes(spark, sf), code_edges(spark, sf))


def _as_bodies(spark, sf):
    e = code_edges(spark, sf)
    return e.withColumn("rel_type", F.when(F.col("rel_type") == "inheritance", "defines_body").otherwise(F.col("rel_type")))


@query("bodies_in_other_files", f"{_W}, m AS (SELECT DISTINCT source_id AS node_id, target_id AS member FROM ce WHERE rel_type = 'defines'), b AS (SELECT DISTINCT source_id AS impl, target_id AS member FROM ce WHERE rel_type = 'inheritance'), r AS (SELECT DISTINCT m.node_id, c.rel_path AS file, c.start_line, c.node_id AS impl, c.source_text FROM m JOIN b USING (member) JOIN cn c ON c.node_id = impl JOIN cn o ON o.node_id = m.node_id WHERE c.rel_path <> o.rel_path) SELECT node_id, file, string_agg(source_text, chr(10) || chr(10) ORDER BY start_line, impl) AS body FROM r GROUP BY 1, 2")
def bodies_in_other_files(spark, sf):
    return R.bodies_elsewhere(code_nodes(spark, sf), _as_bodies(spark, sf))


@query("code_of_symbol", f"{_W} SELECT node_id, array_to_string(string_split(source_text, chr(10))[1:2], chr(10)) AS code FROM cn WHERE lower(symbol_name) = 'note12' ORDER BY node_id LIMIT 1")
def code_of_symbol(spark, sf):
    own = code_nodes(spark, sf).where(F.lower("symbol_name") == "note12").orderBy("node_id").limit(1)
    return own.select("node_id", S.first_lines(F.col("source_text"), 2).alias("code"))


@query("code_by_shortest_name", f"{_W} SELECT node_id, symbol_name FROM cn WHERE symbol_name ILIKE '%bolt1%' ORDER BY length(symbol_name), node_id LIMIT 1")
def code_by_shortest_name(spark, sf):
    return code_nodes(spark, sf).where(F.lower("symbol_name").contains("bolt1")).orderBy(F.length("symbol_name"), "node_id").limit(1).select("node_id", "symbol_name")


@query("text_then_name_hits", f"{_W}, h AS (SELECT node_id, 0 AS src FROM cn WHERE contains(lower(source_text), 'economy') UNION ALL SELECT node_id, 1 FROM cn WHERE contains(lower(symbol_name), 'bolt')) SELECT node_id, CAST(min(src) AS INT) AS origin FROM h GROUP BY 1")
def text_then_name_hits(spark, sf):
    """A union that keeps the first source of each node."""
    n = code_nodes(spark, sf)
    text, name = n.where(F.lower("source_text").contains("economy")).select("node_id", F.lit(0).alias("origin")), n.where(F.lower("symbol_name").contains("bolt")).select("node_id", F.lit(1).alias("origin"))
    return text.union(name).groupBy("node_id").agg(F.min("origin").alias("origin"))


@query("unique_documents", f"{_W} SELECT min(node_id) AS node_id, rel_path, symbol_name, symbol_type FROM cn GROUP BY 2, 3, 4")
def unique_documents(spark, sf):
    """The first of each (file, name, type)."""
    return code_nodes(spark, sf).groupBy("rel_path", "symbol_name", "symbol_type").agg(F.min("node_id").alias("node_id"))


@query("documents_not_retrieved", f"{_W} SELECT node_id FROM cn c WHERE symbol_type = 'class' AND NOT EXISTS (FROM cn x WHERE x.symbol_type = 'struct' AND x.rel_path = c.rel_path)")
def documents_not_retrieved(spark, sf):
    n = code_nodes(spark, sf)
    return n.where("symbol_type = 'class'").join(n.where("symbol_type = 'struct'").select("rel_path"), "rel_path", "left_anti").select("node_id")
