"""From names to nodes: keyed look-ups in order of preference, typed traversal, and searches without an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.graph import BROADCAST_NODES
from graphloom.sources.shared import written


def simple_name(name: Column) -> Column:
    """What follows the last dot, and then the last double colon."""
    return F.element_at(F.split(F.element_at(F.split(name, r"\."), -1), "::"), -1)


def best_by(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys and node_id: of the nodes of a key the one of highest type priority, then of smallest id."""
    rank = F.struct(-S.type_priority(F.col("symbol_type")), F.col("node_id"))
    return nodes.groupBy(*keys).agg(F.min_by("node_id", rank).alias("node_id"))


def resolved(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, file, language of ``names`` with node_id and tier, null where nothing matches.

    Tiers: 1 the exact name in the file and language; 2 its last part there; 3 the full name; 4 a name that ends in it after a
    dot; 5 the name alone.  In tiers 4 and 5 the first candidate (by type priority, then id) whose path contains the file
    or whose language is the wanted one is taken, or else the first.
    """
    own = nodes.where(F.coalesce("symbol_name", F.lit("")) != "").select("node_id", "symbol_type", "symbol_name", "rel_path", "language", *(["full_name"] if "full_name" in nodes.columns else [F.col("symbol_name").alias("full_name")]))
    asked = names.select(F.trim("name").alias("name"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("language", F.lit("")).alias("lang")).where("name <> ''").distinct()
    exact = best_by(own.select(F.col("symbol_name").alias("name"), F.col("rel_path").alias("file"), F.col("language").alias("lang"), "node_id", "symbol_type"), "name", "file", "lang")
    t1 = asked.join(exact, ["name", "file", "lang"]).select("name", "file", "lang", "node_id", F.lit(1).alias("tier"))
    plain = asked.withColumn("simple", simple_name(F.col("name"))).where("simple <> name")
    t2 = plain.join(exact.withColumnRenamed("name", "simple"), ["simple", "file", "lang"]).select("name", "file", "lang", "node_id", F.lit(2).alias("tier"))
    full = best_by(own.select(F.col("full_name").alias("name"), "node_id", "symbol_type"), "name")
    t3 = asked.join(full, "name").select("name", "file", "lang", "node_id", F.lit(3).alias("tier"))
    # the lowest tier counts, so names that these three settle are not asked on
    key = ["name", "file", "lang"]
    found = t1.union(t2).union(t3).groupBy(*key).agg(F.min_by("node_id", "tier").alias("node_id"), F.min("tier").alias("tier"))
    found = written(asked.join(found, key, "left"), "resolved")
    rest = found.where("tier IS NULL").select(*key)
    parts = F.split("full_name", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    suffix = own.where(F.size(parts) > 1).select(F.explode(tails).alias("name"), "node_id", "symbol_type", "rel_path", "language")
    by_name = own.select(F.col("symbol_name").alias("name"), "node_id", "symbol_type", "rel_path", "language")

    def chosen(candidates: DataFrame, tier: int) -> DataFrame:
        hinted = ((F.col("file") != "") & F.contains("rel_path", "file")) | ((F.col("lang") != "") & (F.col("language") == F.col("lang")))
        rank = F.struct(~F.coalesce(hinted, F.lit(False)), -S.type_priority(F.col("symbol_type")), F.col("node_id"))
        # of the candidates of one path, language and type the first alone can be chosen
        first = candidates.join(rest.select("name").distinct(), "name", "left_semi").groupBy("name", "rel_path", "language", "symbol_type").agg(F.min("node_id").alias("node_id"))
        return rest.join(first, "name").groupBy(*key).agg(F.min_by("node_id", rank).alias("node_id")).withColumn("tier", F.lit(tier))

    late = chosen(suffix, 4).union(chosen(by_name, 5)).groupBy(*key).agg(F.min_by("node_id", "tier").alias("node_id"), F.min("tier").alias("tier"))
    return found.where("tier IS NOT NULL").union(rest.join(late, key, "left"))


def relationships(edges: DataFrame, starts: DataFrame, direction: str = "both", depth: int = 2, most: int = 50) -> DataFrame:
    """start, source_id, target_id, rel_type and hop: the distinct typed edges within ``depth`` hops of each start, the nearest
    ``most`` (of equal distance by source, target and relation)."""
    arcs = edges.select("source_id", "target_id", "rel_type")
    out = arcs.select("*", F.col("source_id").alias("at"), F.col("target_id").alias("other"))
    back = arcs.select("*", F.col("target_id").alias("at"), F.col("source_id").alias("other"))
    both = {"outgoing": out, "incoming": back, "both": out.union(back)}[direction]
    frontier = written(starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("at")).distinct(), "frontier")
    seen, found = frontier, None
    for hop in range(1, depth + 1):
        near = F.broadcast(frontier) if frontier.count() <= BROADCAST_NODES else frontier
        step = written(both.join(near, "at").select("start", "source_id", "target_id", "rel_type", "other").distinct(), "step")
        own = step.select("start", "source_id", "target_id", "rel_type").distinct().withColumn("hop", F.lit(hop))
        found = own if found is None else found.union(own)
        if hop < depth:
            frontier = written(step.select("start", F.col("other").alias("at")).distinct().join(seen, ["start", "at"], "left_anti"), "frontier")
            seen = seen.union(frontier)
    found = found.groupBy("start", "source_id", "target_id", "rel_type").agg(F.min("hop").alias("hop"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("hop", "source_id", "target_id", "rel_type"))
    return found.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def scanned(nodes: DataFrame, degree: DataFrame, query: str, k: int = 20, content: bool = False) -> DataFrame:
    """node_id, score, connections without an index: 100 for the name, 50 for a part of it, else 10 for each word in the name.

    Without ``content``: if no word is in the name, 3 for each in the docstring.  With it: 3 for each word in the docstring are
    added, and, below 20, 1 for each in the first 2,000 characters of the text; documents are left out."""
    low = query.lower()
    words = [w for w in low.split() if len(w) >= 2]
    name, doc = F.lower("symbol_name"), F.lower(F.coalesce("docstring", F.lit("")))
    hits = lambda c: sum((c.contains(w).cast("int") for w in words), F.lit(0))
    if content:
        body = F.lower(F.substr(F.coalesce("source_text", F.lit("")), F.lit(1), F.lit(2000)))
        first = F.when(name == low, 100.0).when(name.contains(low), 50.0).otherwise(0.0) + 10.0 * hits(name) + 3.0 * hits(doc)
        score = F.when(first < 20, first + hits(body)).otherwise(first)
        nodes = nodes.where(~S.is_doc_type(F.col("symbol_type")))
    else:
        score = F.when(name == low, 100.0).when(name.contains(low), 50.0).when(hits(name) > 0, 10.0 * hits(name)).otherwise(3.0 * hits(doc))
    own = nodes.where(F.coalesce("symbol_name", F.lit("")) != "").select("node_id", score.alias("score")).where("score > 0")
    own = own.join(degree.select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("connections")), "node_id")
    return own.orderBy(F.desc("score"), F.desc("connections"), "node_id").limit(k)


def neighbours(edges: DataFrame, nodes: DataFrame, relations: tuple[str, ...], direction: str = "successors", most: int = 10, types: tuple[str, ...] = ()) -> DataFrame:
    """node_id and other: per node the first ``most`` typed neighbours of the wanted types, each once."""
    a, b = ("source_id", "target_id") if direction == "successors" else ("target_id", "source_id")
    pairs = edges.where(F.col("rel_type").isin(*relations)).select(F.col(a).alias("node_id"), F.col(b).alias("other")).distinct()
    if types:
        pairs = pairs.join(nodes.where(F.col("symbol_type").isin(*types)).select(F.col("node_id").alias("other")), "other", "left_semi")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("other"))
    return pairs.select("node_id", "other", place.alias("place")).where(F.col("place") <= most).select("node_id", "other")


def through(edges: DataFrame, nodes: DataFrame, first: tuple[str, ...], via: tuple[str, ...], second: tuple[str, ...], most: int) -> DataFrame:
    """node_id and other: what a node's members (of types ``via``) are related to, the first ``most``, not the node itself."""
    member = edges.where(F.col("rel_type").isin(*first)).select(F.col("source_id").alias("node_id"), F.col("target_id").alias("via")).distinct()
    member = member.join(nodes.where(F.col("symbol_type").isin(*via)).select(F.col("node_id").alias("via")), "via", "left_semi")
    onward = edges.where(F.col("rel_type").isin(*second)).select(F.col("source_id").alias("via"), F.col("target_id").alias("other")).distinct()
    pairs = member.join(onward, "via").where("node_id <> other").select("node_id", "other").distinct()
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("other"))
    return pairs.select("node_id", "other", place.alias("place")).where(F.col("place") <= most).select("node_id", "other")


def bodies_elsewhere(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, file, body: implementations (by defines_body) of a class's members in other files, joined by file in order of lines."""
    member = edges.where("rel_type = 'defines'").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("member")).distinct()
    body = edges.where("rel_type = 'defines_body'").select(F.col("source_id").alias("impl"), F.col("target_id").alias("member")).distinct()
    own = nodes.select("node_id", F.col("rel_path").alias("own_file"))
    code = nodes.select(F.col("node_id").alias("impl"), F.col("rel_path").alias("file"), "start_line", "source_text")
    rows = member.join(body, "member").join(code, "impl").join(own, "node_id").where("file <> own_file")
    return rows.groupBy("node_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start_line", "impl", "source_text"))), lambda x: x["source_text"]), "\n\n").alias("body"))


def members_elsewhere(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, file, body: members that a type defines in other files than its own, joined by file in order of lines."""
    own = nodes.select("node_id", F.col("rel_path").alias("own_file"))
    code = nodes.select(F.col("node_id").alias("member"), F.col("rel_path").alias("file"), "start_line", "source_text")
    member = edges.where("rel_type = 'defines'").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("member")).distinct()
    rows = member.join(own, "node_id").join(code, "member").where("file <> own_file")
    return rows.groupBy("node_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start_line", "member", "source_text"))), lambda x: x["source_text"]), "\n\n").alias("body"))


def architectural_parent(nodes: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """node_id and parent: up the ``defines`` and ``contains`` edges, at most ``depth`` steps, to the first architectural node."""
    up = edges.where("rel_type IN ('defines', 'contains')").groupBy(F.col("target_id").alias("at")).agg(F.min("source_id").alias("above"))
    good = nodes.select(F.col("node_id").alias("at"), S.is_architectural_type(F.col("symbol_type")).alias("good"))
    at = nodes.select("node_id", F.col("node_id").alias("at"), S.is_architectural_type(F.col("symbol_type")).alias("good"))
    for _ in range(depth):
        step = at.where("NOT good").drop("good").join(up, "at").select("node_id", F.col("above").alias("at")).join(good, "at")
        at = written(at.where("good").unionByName(step), "parents")
    return at.where("good").select("node_id", F.col("at").alias("parent"))
