"""What a reader of a graph asks for: searches fused from several lists, relations of a name, code, similar names, analyses."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import expand as X
from graphloom.operators import fts
from graphloom.operators import graph as G
from graphloom.operators import resolve as V
from graphloom.operators.orphans import nearest_vectors
from graphloom.operators.search import cutoff
from graphloom.plans.jql import compile_jql
from graphloom.sources.shared import written

#: Endings that say what a class is for.
SUFFIXES = ("wrapper", "apiwrapper", "toolkit", "client", "config", "tool", "toolconfig")


def fused(lists: dict[str, DataFrame], k: int = 60, cap: int = 0, key: Column | None = None) -> DataFrame:
    """key, node_id, score (to six places), sources: reciprocal ranks of ranked lists (node_id, rank and what ``key`` needs) summed by
    key (the name in small letters, or the node without one); the node of the best rank stands for its key; best score first, then
    best rank, then key."""
    own_key = key if key is not None else F.coalesce(F.when(F.trim("symbol_name") != "", F.lower(F.trim("symbol_name"))), F.col("node_id"))
    rows = None
    for source, df in lists.items():
        part = df.select(own_key.alias("key"), "node_id", "rank", F.lit(source).alias("source"))
        rows = part if rows is None else rows.union(part)
    out = rows.groupBy("key").agg(F.min_by("node_id", F.struct("rank", "source", "node_id")).alias("node_id"), F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.min("rank").alias("_best"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    out = out.orderBy(F.desc("score"), "_best", "key").drop("_best")
    return out.limit(cap) if cap else out


def fused_by_id(*lists: DataFrame, k: int = 60) -> DataFrame:
    """node_id, score over any number of lists (node_id, rank); equal scores by node_id, the greatest first."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = None
    for df in lists:
        part = df.select("node_id", (1.0 / (k + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("node_id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), F.desc("node_id"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, connected, degrees, components."""
    d = written(G.degrees(nodes, edges).select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("degree")), "degrees")
    sizes = G.weak_components(nodes, edges).groupBy("component").count()
    parts = sizes.agg(F.count("*").alias("components"), F.max("count").alias("largest"))
    n = F.col("nodes")
    whole = d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("average_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))
    rows = whole.crossJoin(F.broadcast(parts))
    return rows.select("nodes", "edges", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), (F.col("components") == 1).alias("connected"), "average_degree", "max_degree", "min_degree", "components", "largest")


def degree_centrality(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nodes of highest degree / (nodes - 1)."""
    d = G.degrees(nodes, edges).select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    n = nodes.count()
    return d.select("node_id", (F.col("degree") / max(1, n - 1)).alias("centrality")).orderBy(F.desc("centrality"), "node_id").limit(k)


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 20) -> list[str] | None:
    """The nodes of a shortest directed path (of equal ones the smallest ids), or None within ``depth`` steps.

    The frontier carries one node before each node, not paths; the path is read back step by step."""
    spark = edges.sparkSession
    arcs = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    seen = frontier = written(spark.createDataFrame([(source, None, 0)], "node_id string, before string, hop int"), "path")
    for hop in range(1, depth + 1):
        if frontier.where(F.col("node_id") == target).limit(1).count():
            break
        near = F.broadcast(frontier) if frontier.count() <= G.BROADCAST_NODES else frontier
        step = arcs.join(near, F.col("a") == F.col("node_id")).groupBy("b").agg(F.min("a").alias("before")).select(F.col("b").alias("node_id"), "before", F.lit(hop).alias("hop"))
        frontier = written(step.join(seen.select("node_id"), "node_id", "left_anti"), "path")
        if not frontier.limit(1).count():
            return None
        seen = seen.union(frontier)
    out, at = [], target
    while at is not None:
        row = seen.where(F.col("node_id") == at).first()
        if row is None:
            return None
        out.append(at)
        at = row.before
    return out[::-1]


def merged_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """The union of two graphs: the second one's attributes where they are not null, all edges."""
    left, right = a[0], b[0]
    columns = list(dict.fromkeys([*left.columns, *right.columns]))
    rename = right.select(*(F.col(c).alias(c if c == key else f"_r_{c}") for c in right.columns))
    both = left.join(rename, key, "full_outer")
    pick = lambda c: F.coalesce(*([F.col(f"_r_{c}")] if c in right.columns else []), *([F.col(c)] if c in left.columns else [])).alias(c)
    return both.select(*(F.col(key) if c == key else pick(c) for c in columns)), a[1].unionByName(b[1], allowMissingColumns=True)


#: What each likeness of two names adds, and what the sum must exceed.
LIKE_STEM, LIKE_START, LIKE_SUFFIX, LIKE_WORDS, LIKE_INSIDE, LIKE_ACRONYMS, LIKE_SHORT, LIKE_LEAST = 0.6, 0.3, 0.2, 0.4, 0.3, 0.5, 0.4, 0.2


def similar_names(target: str, names: DataFrame, most: int = 3) -> DataFrame:
    """name and score of the names most like ``target``: its stem (the name without a common ending) or its first four letters at
    the beginning, a common ending, words in common, the stem inside, acronyms in common, a short stem at the beginning."""
    low, parts = target.lower(), S.spaced_name(F.col("name"))
    ending = next((s for s in SUFFIXES if low.endswith(s)), "")
    stem = low.removesuffix(ending)
    words = sorted({w for w in re.split("[^a-z]+", low) if w})
    acronyms = sorted({w for w in re.split("[^A-Za-z]+", re.sub("(?<=[A-Z])(?=[A-Z][a-z])", " ", target)) if len(w) > 1 and w.isupper()})
    shared = lambda theirs, own: F.size(F.array_intersect(theirs, F.array(*map(F.lit, own)))) / len(own)
    name = F.col("low")
    likenesses = [
        (bool(stem), F.when(name.startswith(stem), LIKE_STEM).when(F.lit(len(low) >= 4) & name.startswith(low[:4]), LIKE_START)),
        (bool(ending), F.when(reduce(Column.__or__, (name.endswith(s) for s in SUFFIXES)), LIKE_SUFFIX)),
        (bool(words), shared(F.split("low", "[^a-z]+"), words or [""]) * LIKE_WORDS),
        (len(stem) >= 3, F.when(name.contains(stem), LIKE_INSIDE)),
        (bool(acronyms), shared(F.filter(F.split(parts, "[^A-Za-z]+"), lambda w: (F.length(w) > 1) & (w == F.upper(w))), acronyms or [""]) * LIKE_ACRONYMS),
        (2 <= len(stem) <= 4, F.when(name.startswith(stem), LIKE_SHORT)),
    ]
    score = sum((F.coalesce(likeness, F.lit(0.0)) for holds, likeness in likenesses if holds), F.lit(0.0))
    rows = names.select("name").distinct().withColumn("low", F.lower("name")).where(F.col("low") != low).select("name", F.round(score, 9).alias("score"))
    return rows.where(F.col("score") > LIKE_LEAST).orderBy(F.desc("score"), "name").limit(most)


def parsed_json(text: str | None, wanted: str | None = None) -> dict | None:
    """The object of a text: the whole, what stands in a fence, or from its first to its last brace; with the ``wanted`` key if given."""
    text = (text or "").strip()
    tries = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S), *re.findall(r"\{.*\}", text, re.S)]
    for t in tries:
        try:
            out = json.loads(t)
        except ValueError:
            continue
        if isinstance(out, dict) and (wanted is None or wanted in out):
            return out
    return None


def matching_capabilities(analysis: DataFrame, question: str, most: int = 5) -> DataFrame:
    """place, name, score, files of an analysis' capabilities (name, description, keywords, files, place): 3 for each keyword that is a
    word of the question, 2 for each word of the name, 1 for each of the description; the best, in their order."""
    asked = F.array(*map(F.lit, sorted(set(re.findall(r"\b\w+\b", question.lower()))) or [""]))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b\w+\b"), 0))
    keys = F.array_distinct(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: F.lower(x)))
    hit = lambda xs: F.size(F.array_intersect(xs, asked))
    score = 3 * hit(keys) + 2 * hit(words("name")) + hit(words("description"))
    return analysis.select("place", "name", score.alias("score"), "files").where("score > 0").orderBy(F.desc("score"), "place").limit(most)


def files_for(analysis: DataFrame, question: str, most: int = 20) -> DataFrame:
    """place and file: the files of the matching capabilities, each once, in order."""
    rows = matching_capabilities(analysis, question).select(F.row_number().over(Window.orderBy(F.desc("score"), "place")).alias("_c"), F.posexplode("files").alias("_p", "file"))
    first = rows.groupBy("file").agg(F.min(F.struct("_c", "_p")).alias("at"))
    return first.orderBy("at").limit(most).select(F.row_number().over(Window.orderBy("at")).alias("place"), "file")


@dataclass
class GraphTools:
    """Searches and look-ups over one graph; ``vectors(node_id, embedding)`` and a query's embedding are optional."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    index: fts.Index
    vectors: DataFrame | None = None

    def _named(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.nodes.select("node_id", "symbol_name", "symbol_type", "rel_path"), "node_id")

    def _text(self, query: str, k: int, intent: str = "general", among: DataFrame | None = None) -> DataFrame:
        hits = fts.search(self.index, fts.from_question(query, intent), fts.SYMBOL_WEIGHTS, k, among)
        return self._named(hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_id"))))

    def _near(self, embedding: list[float], k: int) -> DataFrame:
        asked = self.spark.createDataFrame([("q", embedding)], "orphan string, embedding array<double>")
        return self._named(nearest_vectors(asked, self.vectors, k).select("node_id", "rank", "distance"))

    def search_codebase(self, query: str, k: int = 10, embedding: list[float] | None = None) -> DataFrame:
        """At most three documents by vectors and at least ten code symbols by text, fused, at most 2 k."""
        code = self.nodes.where(~S.is_doc_type(F.col("symbol_type"))).select("node_id")
        lists = {"fts": self._text(query, max(10, k), among=code)}
        if embedding is not None and self.vectors is not None:
            docs = self._near(embedding, max(k, 10)).where(S.is_doc_type(F.col("symbol_type"))).orderBy("rank").limit(3)
            lists["vectors"] = docs.withColumn("rank", F.row_number().over(Window.orderBy("rank")))
        return fused(lists, cap=2 * k)

    def search_repository(self, query: str, k: int = 15, embedding: list[float] | None = None, most: int = 150) -> DataFrame:
        """node_id and origin: the weighted fusion of text (0.4) and vectors (0.6), then the hits' architectural neighbours."""
        hits = self._text(query, 30).select("node_id", (0.4 / (60 + F.col("rank"))).alias("s"))
        if embedding is not None and self.vectors is not None:
            hits = hits.union(self._near(embedding, 30).select("node_id", (0.6 / (60 + F.col("rank"))).alias("s")))
        best = written(hits.groupBy("node_id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "node_id").limit(k), "hits")
        near = X.page_neighbours(best, self.nodes, self.edges).select(F.col("other").alias("node_id"), F.col("weight").alias("score"))
        near = near.join(best, "node_id", "left_anti").groupBy("node_id").agg(F.max("score").alias("score"))
        rows = best.select("node_id", "score", F.lit(0).alias("step")).union(near.select("node_id", "score", F.lit(1)))
        return rows.orderBy("step", F.desc("score"), "node_id").limit(most).select("node_id", F.when(F.col("step") == 0, "hit").otherwise("neighbour").alias("origin"))

    def search_symbols(self, query: str, k: int = 20, symbol_type: str | None = None, prefix: str | None = None) -> DataFrame:
        """By text, of a type and below a path; by a scan of the names where no word of the query is in the index."""
        among = self.nodes.where(F.col("symbol_type") == symbol_type.lower()) if symbol_type else self.nodes
        among = among.where(S.within(F.col("rel_path"), prefix)) if prefix else among
        found = self._text(query, k, among=among.select("node_id") if symbol_type or prefix else None)
        if not found.limit(1).count():
            found = self._named(V.scanned(among, G.degrees(self.nodes, self.edges), query, k))
        return found.select("node_id", "symbol_name", "symbol_type", "rel_path", "score").orderBy(F.desc("score"), "node_id")

    def relationships(self, name: str, direction: str = "both", depth: int = 2, most: int = 50) -> DataFrame:
        """The typed edges around the node of a name; around none, the texts that hold the name."""
        asked = self.spark.createDataFrame([(name, "", "")], "name string, file string, language string")
        start = V.resolved(asked, self.nodes).where("node_id IS NOT NULL").select("node_id")
        found = V.relationships(self.edges, start, direction, depth, most)
        if found.limit(1).count():
            return found
        lost = start.join(self.nodes.select("node_id", "symbol_name"), "node_id")
        return X.framework_references(lost, self.nodes, self.index).select(F.col("source_id").alias("start"), "source_id", "target_id", F.lit("mentioned_in").alias("rel_type"), F.lit(1).alias("hop"))

    def search_graph(self, query: str, k: int = 5, neighbours: int = 8) -> DataFrame:
        """node_id, direction, other: the best symbols and up to ``neighbours`` on each side."""
        hits = self._text(query, k, "symbol").select("node_id")
        pairs = self.edges.select("source_id", "target_id").distinct()
        out = pairs.select(F.col("source_id").alias("node_id"), F.lit("out").alias("direction"), F.col("target_id").alias("other"))
        both = out.union(pairs.select(F.col("target_id"), F.lit("in"), F.col("source_id"))).join(F.broadcast(hits), "node_id", "left_semi")
        place = F.row_number().over(Window.partitionBy("node_id", "direction").orderBy("other"))
        return hits.join(both.withColumn("_r", place).where(F.col("_r") <= neighbours).drop("_r"), "node_id", "left")

    def get_code(self, name: str, lines: int = 200) -> DataFrame:
        """node_id and code of the node of a name, at most ``lines`` lines; of the shortest name that holds it, if none has it."""
        low = F.lower("symbol_name")
        exact = self.nodes.where(low == name.lower()).orderBy("node_id").limit(1)
        own = exact if exact.count() else self.nodes.where(low.contains(name.lower())).orderBy(F.length("symbol_name"), "node_id").limit(1)
        return own.select("node_id", S.first_lines(F.col("source_text"), lines).alias("code"))

    def search_docs(self, query: str, k: int = 5, embedding: list[float] | None = None, threshold: float = 0.7) -> DataFrame:
        """Documents by vectors (or by text) from a pool of max(5 k, 50), those near enough to the best."""
        pool = max(5 * k, 50)
        if embedding is not None and self.vectors is not None:
            hits = self._near(embedding, pool).where(S.is_doc_type(F.col("symbol_type"))).select("node_id", (1 / (1 + F.col("distance"))).alias("score"))
        else:
            hits = self._text(query, pool, "doc", self.nodes.where(S.is_doc_type(F.col("symbol_type"))).select("node_id")).select("node_id", "score")
        return cutoff(hits.withColumnRenamed("node_id", "doc_id"), threshold, k).withColumnRenamed("doc_id", "node_id")

    def query_graph(self, expression: str) -> DataFrame:
        return compile_jql(expression, self.nodes, self.edges)

    def page(self, names: list[str], macro: int | None = None, budget: int = 50_000, most: int = 200) -> DataFrame:
        """node_id, stage, tokens of a page's documents within a token budget, in stages: the named symbols (until one does not fit),
        texts that use those without edges, then neighbours and the section's documents (those that fit).

        The candidates are at most 5 for each name, 15 neighbours of each and 200 documents: they are folded in one task."""
        nodes = self.nodes if macro is None else self.nodes.where(F.col("macro_cluster") == macro)
        place = F.row_number().over(Window.partitionBy("symbol_name").orderBy((F.col("end_line") - F.col("start_line")).desc(), "node_id"))
        named = nodes.where(F.col("symbol_name").isin(*names) & S.is_architectural_type(F.col("symbol_type"))).withColumn("_r", place).where("_r <= 5")
        seeds = written(named.select("node_id", "symbol_name"), "seeds")
        degree = self.edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).join(F.broadcast(seeds.select("node_id")), "node_id", "left_semi").groupBy("node_id").count()
        lost = seeds.join(degree, "node_id", "left").where("coalesce(count, 0) <= 1").select("node_id", "symbol_name")
        stages = [seeds.select("node_id", F.lit(0).alias("stage"), F.lit(0.0).alias("order")), X.framework_references(lost, self.nodes, self.index).select(F.col("target_id"), F.lit(1), F.lit(0.0))]
        near = X.valid_expansions(X.page_neighbours(seeds, self.nodes, self.edges), self.nodes, macro=macro).groupBy("other").agg(F.max("weight").alias("w"))
        stages.append(near.select("other", F.lit(2), -F.col("w")))
        docs = nodes.where(S.is_doc_type(F.col("symbol_type"))).orderBy("rel_path", "node_id").limit(most) if macro is not None else nodes.limit(0)
        stages.append(docs.select("node_id", F.lit(3), F.lit(0.0)))
        rows = stages[0]
        for s in stages[1:]:
            rows = rows.union(s)
        rows = rows.groupBy("node_id").agg(F.min(F.struct("stage", "order")).alias("at")).select("node_id", "at.stage", "at.order")
        rows = rows.join(self.nodes.select("node_id", S.estimated_tokens(F.col("source_text")).alias("tokens")), "node_id").withColumn("page", F.lit("page"))
        return X.greedy_budget(rows, "page", ["stage", "order", "node_id"], "tokens", budget).select("node_id", "stage", "tokens").orderBy("stage", "node_id").limit(most)
