"""Queries over the corpus, vector, path and event views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import expand as X
from graphloom.operators import fts
from graphloom.operators import search as K
from graphloom.plans.registry import query
from graphloom.plans.views import CORPUS_SQL, corpus, table, vectors
from graphloom.streaming import events as E

r6 = lambda c: F.round(c, 6)
_C = f"WITH {CORPUS_SQL}"
TERMS = ["the", "and", "thtion"]


def _okapi_index(spark, sf):
    return fts.kept(spark, "okapi", [f"{sf}/documents.parquet"], lambda: fts.text_index(table(spark, sf, "documents")))


def _okapi_best(spark, sf, k=20, among=None):
    return fts.okapi(_okapi_index(spark, sf), TERMS, k, among)


def _words_index(spark, sf):
    """Words of texts and paths, with underscores inside words."""
    return fts.kept(spark, "words", [f"{sf}/documents.parquet"], lambda: fts.build(corpus(spark, sf), "doc_id", {"text": F.col("text"), "path": F.col("path")}, K.word_tokens))


_TOK = "tok AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS t FROM corpus)"
_WORDS = "tok AS (SELECT *, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '') AS t FROM corpus)"


def _okapi(where: str = "true", terms=TERMS) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{x}')) AS tf{i}" for i, x in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    s = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"{_TOK}, c AS (SELECT doc_id, language, path, len(t)::DOUBLE AS dl, {tf} FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM c WHERE dl > 0), bm AS (SELECT doc_id, {s} AS score FROM c, st WHERE ({hit}) AND ({where}))"


@query("bm25_okapi", f"{_C}, {_okapi()} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_okapi(spark, sf):
    return _okapi_best(spark, sf).withColumn("score", r6("score"))


_IN = "language = 'en' AND (path LIKE 'src1/%' OR path LIKE 'src2/%')"


@query("bm25_filtered", f"{_C}, {_okapi(_IN)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_filtered(spark, sf):
    inside = (F.col("language") == "en") & (S.within(F.col("path"), "src1") | S.within(F.col("path"), "src2"))
    return _okapi_best(spark, sf, among=corpus(spark, sf).where(inside)).withColumn("score", r6("score"))


def _weighted(match: str) -> str:
    terms = ["tion", "en"]
    f = ", ".join(f"1.0 * len(list_filter(t, lambda x: {match.format(x=x)})) + 10.0 * len(list_filter(p, lambda x: {match.format(x=x)})) AS f{i}" for i, x in enumerate(terms))
    df = ", ".join(f"sum((f{i} > 0)::INT) AS df{i}" for i in range(2))
    s = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(2))
    return f"{_C}, {_WORDS}, tk AS (SELECT doc_id, t, list_filter(string_split_regex(lower(path), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '') AS p FROM tok), c AS (SELECT doc_id, (len(t) + len(p))::DOUBLE AS dl, {f} FROM tk), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM c), bm AS (SELECT doc_id, {s} AS score FROM c, st WHERE f0 > 0 OR f1 > 0) SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20"


@query("bm25_weighted_cols", _weighted("x = '{x}'"))
def bm25_weighted_cols(spark, sf):
    return fts.search(_words_index(spark, sf), [[fts.phrase(w)] for w in ("tion", "en")], {"text": 1.0, "path": 10.0}, 20).withColumn("score", r6("score"))


@query("prefix_search", _weighted("starts_with(x, '{x}')"))
def prefix_search(spark, sf):
    return fts.search(_words_index(spark, sf), [[fts.phrase(w, True)] for w in ("tion", "en")], {"text": 1.0, "path": 10.0}, 20).withColumn("score", r6("score"))


@query("phrase_search", f"{_C}, {_WORDS} SELECT doc_id FROM tok WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' all rights reserved ')")
def phrase_search(spark, sf):
    """By postings of the three words alone."""
    return fts.phrase_hits(_words_index(spark, sf), fts.Phrase(("all", "rights", "reserved"), False, "text"), {}).select("doc_id")


@query("near_search", f"{_C}, {_WORDS}, p AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok) SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 6 WHERE a.w = 'apache' AND b.w = 'version'")
def near_search(spark, sf):
    """By postings of the two words alone."""
    return fts.phrase_hits(_words_index(spark, sf), fts.Near((fts.phrase("apache"), fts.phrase("version")), 5, "text"), {}).select("doc_id")


@query("near_four_words", f"{_C}, {_WORDS}, p AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok), e AS (SELECT doc_id, w, i, max(CASE WHEN w = 'apache' THEN i END) OVER o AS a, max(CASE WHEN w = 'license' THEN i END) OVER o AS b, max(CASE WHEN w = 'version' THEN i END) OVER o AS c, max(CASE WHEN w = 'the' THEN i END) OVER o AS d FROM p WHERE w IN ('apache', 'license', 'version', 'the') WINDOW o AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, count(*) AS clumps FROM e WHERE i - least(a, b, c, d) - 1 <= 12 AND a + b + c + d IS NOT NULL GROUP BY 1")
def near_four_words(spark, sf):
    """Documents that hold four words close together, in any order, and how many windows they close."""
    group = fts.Near(tuple(map(fts.phrase, ("apache", "license", "version", "the"))), 12, "text")
    return fts.phrase_hits(_words_index(spark, sf), group, {}).select("doc_id", F.col("f").cast("long").alias("clumps"))


@query("count_matches", f"{_C}, {_WORDS} SELECT count(*) FILTER (list_contains(t, 'the') AND list_contains(t, 'license')) AS both, count(*) FILTER (list_contains(t, 'license')) AS one FROM tok")
def count_matches(spark, sf):
    t = corpus(spark, sf).select(K.word_tokens(F.col("text")).alias("t"))
    return t.agg(F.count_if(F.array_contains("t", "the") & F.array_contains("t", "license")).alias("both"), F.count_if(F.array_contains("t", "license")).alias("one"))


@query("like_search", f"{_C} SELECT doc_id, path FROM corpus WHERE lower(text) LIKE '%license%' ORDER BY path, doc_id LIMIT 30")
def like_search(spark, sf):
    return corpus(spark, sf).where(F.lower("text").contains("license")).select("doc_id", "path").orderBy("path", "doc_id").limit(30)


@query("term_idf", f"{_C}, {_WORDS} SELECT term, CAST(sum(list_contains(t, term)::INT) AS BIGINT) AS df, round(ln(count(*)::DOUBLE / (1 + sum(list_contains(t, term)::INT))), 6) AS idf FROM tok, (VALUES ('the'), ('license'), ('zzz')) v(term) GROUP BY 1")
def term_idf(spark, sf):
    return K.idf(corpus(spark, sf), ["the", "license", "zzz"]).withColumn("idf", r6("idf"))


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_L2 = "list_distance(e, q)"


def _to(spark, sf):
    return vectors(spark, sf).where("vec_id = 7").select(F.col("embedding").alias("q"))


@query("knn_l2", f"WITH {_Q} SELECT vec_id, label, round({_L2}, 6) AS distance FROM v, q ORDER BY {_L2}, vec_id LIMIT 10")
def knn_l2(spark, sf):
    return K.knn(vectors(spark, sf), _to(spark, sf), 10).withColumn("distance", r6("distance"))


@query("knn_cosine", f"WITH {_Q} SELECT vec_id, label, round(1 - list_cosine_similarity(e, q), 6) AS distance FROM v, q ORDER BY 1 - list_cosine_similarity(e, q), vec_id LIMIT 10")
def knn_cosine(spark, sf):
    return K.knn(vectors(spark, sf), _to(spark, sf), 10, "cosine").withColumn("distance", F.abs(r6("distance")))


@query("knn_filtered_post", f"WITH {_Q}, h AS (SELECT vec_id, label, round({_L2}, 6) AS distance FROM v, q ORDER BY {_L2}, vec_id LIMIT 50) SELECT * FROM h WHERE label % 2 = 0")
def knn_filtered_post(spark, sf):
    """The filter follows the limit, so fewer than k may be left."""
    return K.knn(vectors(spark, sf), _to(spark, sf), 50).withColumn("distance", r6("distance")).where("label % 2 = 0")


@query("knn_filtered_pre", f"WITH {_Q} SELECT vec_id, label, round({_L2}, 6) AS distance FROM v, q WHERE label = 3 ORDER BY {_L2}, vec_id LIMIT 10")
def knn_filtered_pre(spark, sf):
    return K.knn(vectors(spark, sf).where("label = 3"), _to(spark, sf), 10).withColumn("distance", r6("distance"))


@query("nodes_in_cluster", "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 1000")
def nodes_in_cluster(spark, sf):
    return table(spark, sf, "embeddings").where("label = 3").select("vec_id", "label").orderBy("vec_id").limit(1000)


_FTS = f"fts AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 30), vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_L2}, vec_id) AS r FROM v, q QUALIFY r <= 30)"


def _lists(spark, sf):
    fts = K.ranked_list(_okapi_best(spark, sf, 30), "doc_id", [F.desc("score"), F.col("doc_id")])
    vec = K.ranked_list(K.knn(vectors(spark, sf), _to(spark, sf), 30).withColumnRenamed("vec_id", "doc_id"), "doc_id", [F.col("distance"), F.col("doc_id")])
    return fts, vec


@query("hybrid_search", f"{_C}, {_okapi()}, {_Q}, {_FTS} SELECT doc_id, round(sum(s), 9) AS score, count(*) AS lists FROM (SELECT doc_id, 0.4::DOUBLE / (60 + r) AS s FROM fts UNION ALL SELECT doc_id, 0.6::DOUBLE / (60 + r) FROM vec) GROUP BY 1 ORDER BY sum(s) DESC, doc_id LIMIT 20")
def hybrid_search(spark, sf):
    """Full-text and vector lists fused; document and vector ids share one key space here."""
    fts, vec = _lists(spark, sf)
    return K.rrf([(fts, 0.4), (vec, 0.6)], "doc_id").orderBy(F.desc("score"), "doc_id").limit(20).withColumn("score", F.round("score", 9))


@query("rrf_both_lists", f"{_C}, {_okapi()}, {_Q}, {_FTS} SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (FROM fts UNION ALL FROM vec) GROUP BY 1 HAVING sum(1.0::DOUBLE / (60 + r)) >= 0.02 ORDER BY 2 DESC, 1 DESC")
def rrf_both_lists(spark, sf):
    """Unweighted fusion with the threshold that only hits of both lists reach."""
    fts, vec = _lists(spark, sf)
    return K.rrf([(fts, 1.0), (vec, 1.0)], "doc_id").where("score >= 0.02").select("doc_id", F.round("score", 9).alias("score"))


@query("docs_semantic_cutoff", f"{_C}, {_okapi()}, h AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50) SELECT doc_id, round(score, 6) AS score FROM h WHERE score >= (SELECT max(score) FROM h) * 0.98 ORDER BY h.score DESC, doc_id LIMIT 10")
def docs_semantic_cutoff(spark, sf):
    return K.cutoff(_okapi_best(spark, sf, 50), 0.02, 10).withColumn("score", r6("score"))


@query("token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(1, floor(length(text) / 3.5)) AS BIGINT) END AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))


@query("url_parts", r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '^/(api|rest|graphql)(/v[0-9]+)?', '') AS path FROM pages")
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.host(F.col("url")).alias("host"), S.url_path(F.col("url")).alias("path"))


@query("path_prefixes", "SELECT page_id, unnest([array_to_string(p[1:i], '/') FOR i IN range(len(p) - 1, -1, -1)]) AS prefix FROM (SELECT page_id, string_split(regexp_extract(url, '^[a-zA-Z]+://(.*)$', 1), '/') AS p FROM pages)")
def path_prefixes(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(S.path_prefixes(F.regexp_extract("url", "^[a-zA-Z]+://(.*)$", 1))).alias("prefix"))


@query("name_tokens", r"SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS tokens FROM part")
def name_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.name_tokens(F.col("p_name")).alias("tokens"))


@query("test_path_flag", "SELECT page_id, regexp_matches(url, '(?i)(^|/)(en|de)/[0-9]') AS flagged, regexp_matches(regexp_replace(url, '/(en|de)/', '/tests/'), '(?i)(^|/)(tests?|__tests__|spec|specs|testing|testdata|fixtures|mocks?)/') AS test FROM pages")
def test_path_flag(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike("(?i)(^|/)(en|de)/[0-9]").alias("flagged"), S.is_test_path(F.regexp_replace("url", "/(en|de)/", "/tests/")).alias("test"))


@query("score_norm", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE round(1 / (1 + exp(-c_acctbal / 5000)), 6) END AS norm FROM customer")
def score_norm(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r6(S.score_norm(F.when(F.col("c_custkey") % 7 != 0, -F.col("c_acctbal") / 5000))).alias("norm"))


@query("size_rules", "SELECT k, CASE WHEN k < 100 THEN 25 WHEN k < 500 THEN 35 WHEN k < 2000 THEN 45 ELSE 60 END AS page_cap, CAST(greatest(3, least(15, round_even(3 * log10(greatest(k, 1)), 0))) AS INT) AS sections, round(greatest(0.3, 1 - 0.2 * log10(greatest(k, 1))), 6) AS resolution FROM (SELECT o_orderkey AS k FROM orders)")
def size_rules(spark, sf):
    k = F.col("k")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select("k", S.page_size_cap(k).alias("page_cap"), S.section_cap(k).alias("sections"), r6(S.auto_resolution(k)).alias("resolution"))


@query("json_annotations", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_annotations(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return E.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", "WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS fresh FROM events), s AS (SELECT *, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, g")
def event_sessions(spark, sf):
    return E.sessions(table(spark, sf, "events"))


@query("upsert_last_write", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_write(spark, sf):
    return E.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("stale_purge", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def stale_purge(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def set_intersect(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("dedup_keep_first", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("dominant_language", "SELECT source, arg_max(lang, (n, lang)) AS lang, max(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def dominant_language(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").count().groupBy("source").agg(F.max_by("lang", F.struct("count", "lang")).alias("lang"), F.max("count").alias("n"))


@query("coverage", "SELECT source, count(*) AS total, count(l.doc_id) AS covered, round(count(l.doc_id) / count(*), 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def coverage(spark, sf):
    seen = table(spark, sf, "labels").select("doc_id").distinct().withColumn("y", F.lit(1))
    return table(spark, sf, "documents").select("doc_id", "source").join(seen, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("y").alias("covered"), r6(F.count("y") / F.count("*")).alias("share"))


@query("overlap_pairs", "WITH s AS (SELECT DISTINCT o_custkey % 40 AS g, l_partkey % 100 AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 50 = 0), z AS (SELECT g, count(*) AS n FROM s GROUP BY 1) SELECT a.g AS a, b.g AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.g < b.g JOIN z za ON za.g = a.g JOIN z zb ON zb.g = b.g GROUP BY 1, 2, za.n, zb.n HAVING count(*) > 0.5 * least(za.n, zb.n)")
def overlap_pairs(spark, sf):
    """Pairs of pages that share more than half of the smaller one's symbols."""
    o = table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 40).alias("g"))
    s = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).alias("x")).join(o, "l_orderkey").select("g", "x").distinct()
    return X.overlaps(s)


@query("overlap_pairs_all", "WITH s AS (SELECT DISTINCT o_custkey AS g, l_partkey AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey), z AS (SELECT g, count(*) AS n FROM s GROUP BY 1) SELECT a.g AS a, b.g AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.g < b.g JOIN z za ON za.g = a.g JOIN z zb ON zb.g = b.g GROUP BY 1, 2, za.n, zb.n HAVING count(*) > 0.5 * least(za.n, zb.n)")
def overlap_pairs_all(spark, sf):
    """The same over all orders and their items: every customer is a page, every part a symbol."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("g"))
    return X.overlaps(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("x")).join(o, "l_orderkey").select("g", "x").distinct())


_SURF = r"SELECT page_id AS id, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS g, regexp_extract(url, '([0-9]{1,2})\.html', 1) AS k FROM pages"


@query("surface_pairs", f"WITH s AS ({_SURF}) SELECT a.id AS a, b.id AS b, a.k FROM s a JOIN s b ON a.k = b.k AND a.id < b.id AND a.g <> b.g WHERE a.k <> ''")
def surface_pairs(spark, sf):
    """Pages of different languages with the same surface (the last digits of their paths)."""
    s = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1).alias("g"), F.regexp_extract("url", r"([0-9]{1,2})\.html", 1).alias("k"))
    return X.linked_by_key(s, "k", "g", False)


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("budget_greedy")
def budget_greedy(spark, sf):
    """Per source the documents that fit a token budget; an oversized one is skipped."""
    d = table(spark, sf, "documents").select("source", "doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))
    return X.greedy_budget(d, "source", ["doc_id"], "tokens", 20_000)
