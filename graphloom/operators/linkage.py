"""Edges that no parser gives: test links, links of documentation, bridges between components, links across languages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import graph as G
from graphloom.sources.shared import written

FILE_LEVEL = ("module", "module_doc", "file_doc")
#: How many symbols a quoted name and a directory stand for at most.
NAMES_PER_REFERENCE, NODES_PER_DIRECTORY = 2, 5


def same_stem(nodes: DataFrame) -> DataFrame:
    """source_id (a test's file node) and target_id (the file node of the stem without its decoration, in the same language)."""
    own = nodes.where(F.lower("symbol_type").isin(*FILE_LEVEL) & (F.coalesce("file_name", F.lit("")) != ""))
    own = own.select("node_id", F.lower("file_name").alias("stem"), F.lower(F.coalesce("language", F.lit(""))).alias("lang"), S.is_test_node(F.col("rel_path"), F.col("file_name")).alias("test"))
    tests = own.where("test").select(F.col("node_id").alias("source_id"), S.stripped_test_name(F.col("stem")).alias("stem"), "lang")
    return tests.join(own.where("NOT test").select(F.col("node_id").alias("target_id"), "stem", "lang"), ["stem", "lang"]).select("source_id", "target_id")


def class_proxy(nodes: DataFrame) -> DataFrame:
    """source_id (a test class) and target_id (the class that it is named after, in the same language)."""
    own = nodes.where((F.lower("symbol_type") == "class") & (F.coalesce("symbol_name", F.lit("")) != ""))
    own = own.select("node_id", F.col("symbol_name").alias("name"), F.lower(F.coalesce("language", F.lit(""))).alias("lang"), (S.is_test_node(F.col("rel_path"), F.col("file_name")) & F.col("symbol_name").rlike("^Test|Tests?$")).alias("test"))
    tests = own.where("test").select(F.col("node_id").alias("source_id"), S.stripped_test_class(F.col("name")).alias("name"), "lang")
    return tests.join(own.where("NOT test").select(F.col("node_id").alias("target_id"), "name", "lang"), ["name", "lang"]).select("source_id", "target_id")


def test_links(nodes: DataFrame) -> DataFrame:
    """Both kinds, once each: source_id, target_id, rel_type, edge_class, weight."""
    kind = lambda df, rel: df.select("source_id", "target_id", F.lit(rel).alias("rel_type"))
    both = kind(same_stem(nodes), "test_link_same_stem").union(kind(class_proxy(nodes), "test_link_class_proxy")).distinct()
    return both.withColumn("edge_class", F.lit("test_link")).withColumn("weight", F.lit(0.5))


def resolved_path(reference: Column, directory: Column) -> Column:
    """A relative reference against a directory, without anchors, dots and parents; empty for addresses and anchors.

    Only built-in functions: the segments are folded over a stack."""
    bare = F.trim(F.split(reference, "#")[0])
    bare = F.when(bare.startswith("./"), F.substr(bare, F.lit(3))).otherwise(bare)
    whole = F.when(bare.startswith("/"), bare).when(directory == "", bare).otherwise(F.concat_ws("/", directory, bare))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))

    def step(stack: Column, x: Column) -> Column:
        n = F.size(stack)
        up = (x == "..") & (n > 0) & (F.get(stack, n - 1) != "..")
        return F.when(up, F.slice(stack, F.lit(1), n - 1)).otherwise(F.concat(stack, F.array(x)))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    outside = bare.rlike("^(https?://|mailto:)") | (bare == "") | reference.startswith("#")
    return F.when(outside, "").otherwise(folded)


def _documents(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_doc_node(F.col("symbol_type")))


def is_doc_node(kind: Column) -> Column:
    return kind.isin("module_doc", "file_doc", "doc", "readme", "documentation", "markdown", "rst", "text") | kind.rlike("_(document|section)$")


def explicit_references(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id and matcher: Markdown links resolved to files, and names in backticks, at most
    NAMES_PER_REFERENCE symbols of a name (of the whole, or else of its last part), the smallest ids first."""
    own = docs.select(F.col("node_id").alias("source_id"), S.directory(F.coalesce("rel_path", F.lit(""))).alias("dir"), F.coalesce("source_text", F.lit("")).alias("text"))
    links = own.select("source_id", "dir", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), 1)).alias("ref"))
    links = links.select("source_id", resolved_path(F.col("ref"), F.col("dir")).alias("rel_path")).where("rel_path <> ''")
    files = nodes.where(F.coalesce("rel_path", F.lit("")) != "").groupBy("rel_path").agg(F.max("node_id").alias("target_id"))
    by_link = links.join(files, "rel_path").select("source_id", "target_id", F.lit("md_link").alias("matcher"))
    names = nodes.where(~is_doc_node(F.col("symbol_type")) & (F.coalesce("symbol_name", F.lit("")) != ""))
    place = F.row_number().over(Window.partitionBy("symbol_name").orderBy("node_id"))
    names = names.select("symbol_name", F.col("node_id").alias("target_id"), place.alias("place")).where(F.col("place") <= NAMES_PER_REFERENCE)
    quoted = own.select("source_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_]\w+(?:\.\w+)*)`"), 1))).alias("name"))
    quoted = quoted.select("source_id", "name", F.element_at(F.split("name", r"\."), -1).alias("last"))
    known = names.where("place = 1").select("symbol_name", F.lit(True).alias("known"))
    quoted = quoted.join(known.withColumnRenamed("symbol_name", "name"), "name", "left")
    quoted = quoted.select("source_id", F.when(F.col("known"), F.col("name")).otherwise(F.col("last")).alias("symbol_name"))
    by_name = quoted.join(names, "symbol_name").select("source_id", "target_id", F.lit("backtick").alias("matcher"))
    return by_link.union(by_name).where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.max("matcher").alias("matcher"))


def imported(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id, target_id, matcher for ``imports(node_id, name)``: the file of that path, or else symbols of the name's last part."""
    wanted = imports.select(F.col("node_id").alias("source_id"), "name", F.element_at(F.split("name", r"\."), -1).alias("last"))
    files = nodes.where(F.coalesce("rel_path", F.lit("")) != "").groupBy(F.col("rel_path").alias("name")).agg(F.max("node_id").alias("file"))
    wanted = wanted.join(files, "name", "left")
    by_path = wanted.where("file IS NOT NULL").select("source_id", F.col("file").alias("target_id"), F.lit("import_path").alias("matcher"))
    place = F.row_number().over(Window.partitionBy("symbol_name").orderBy("node_id"))
    names = nodes.where(~is_doc_node(F.col("symbol_type"))).select(F.col("symbol_name").alias("last"), F.col("node_id").alias("target_id"), place.alias("place"))
    by_name = wanted.where("file IS NULL").join(names.where(F.col("place") <= NAMES_PER_REFERENCE), "last").select("source_id", "target_id", F.lit("import_symbol").alias("matcher"))
    return by_path.union(by_name).where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.min("matcher").alias("matcher"))


def proximity(nodes: DataFrame) -> DataFrame:
    """source_id (a document) and target_id: up to NODES_PER_DIRECTORY code nodes of every directory that is the document's
    topic directory or ends with it."""
    placed = nodes.select("node_id", is_doc_node(F.col("symbol_type")).alias("doc"), S.directory(F.coalesce("rel_path", F.lit(""))).alias("dir")).where("dir <> ''")
    topic = F.regexp_replace("dir", "^(docs|doc|documentation)/", "")
    docs = placed.where("doc").select(F.col("node_id").alias("source_id"), topic.alias("topic"))
    place = F.row_number().over(Window.partitionBy("dir").orderBy("node_id"))
    code = placed.where("NOT doc").select("dir", F.col("node_id").alias("target_id"), place.alias("place")).where(F.col("place") <= NODES_PER_DIRECTORY)
    parts = F.split("dir", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return docs.join(code.select(F.explode(suffixes).alias("topic"), "target_id"), "topic").where("source_id <> target_id").select("source_id", "target_id").distinct()


def doc_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links and quoted names, then nearness; each pair once, and none that an edge joins already."""
    links = explicit_references(_documents(nodes), nodes).select("source_id", "target_id", F.lit("hyperlink").alias("rel_type"))
    near = proximity(nodes).select("source_id", "target_id", F.lit("proximity").alias("rel_type"))
    new = links.union(near).groupBy("source_id", "target_id").agg(F.min("rel_type").alias("rel_type"))
    return new.join(edges.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti").withColumn("edge_class", F.lit("doc"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id in both directions: every component but the largest is tied to that larger one which shares most
    of its directories (the largest, if none does), by their nodes of highest degree.

    Components are ranked by size, then by their smallest node.  They meet by directory, so the work follows the
    directories that they share, not the pairs of components.
    """
    degree = G.degrees(nodes, edges).select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    path = F.coalesce("rel_path", "file_name") if "file_name" in nodes.columns else F.col("rel_path")
    placed = nodes.select("node_id", F.when(path.contains("/"), S.directory(path)).otherwise("<root>").alias("dir"))
    rows = written(G.weak_components(nodes, edges).join(degree, "node_id").join(placed, "node_id"), "bridges")
    found = rows.groupBy("component").agg(F.count("*").alias("size"), F.max_by("node_id", F.struct("degree", "node_id")).alias("rep"))
    found = written(found, "components")
    order = F.struct(-F.col("size"), F.col("component"))
    top = found.agg(F.min_by("component", order).alias("first"), F.min_by("rep", order).alias("first_rep"))
    held = rows.groupBy("component", "dir").count().join(found.select("component", "size"), "component")
    side = lambda x: held.select("dir", *(F.col(c).alias(f"{x}_{c}") for c in ("component", "count", "size")))
    pairs = side("a").join(side("b"), "dir").where("b_size > a_size OR (b_size = a_size AND b_component < a_component)")
    shared = pairs.groupBy("a_component", "b_component", "b_size").agg(F.sum(F.least("a_count", "b_count")).alias("shared"))
    best = shared.groupBy(F.col("a_component").alias("component")).agg(F.min_by("b_component", F.struct(-F.col("shared"), -F.col("b_size"), F.col("b_component"))).alias("to"))
    tied = found.join(best, "component", "left").crossJoin(F.broadcast(top)).where("component <> first")
    tied = tied.select("rep", F.coalesce("to", "first").alias("to")).join(found.select(F.col("component").alias("to"), F.col("rep").alias("to_rep")), "to")
    pairs = tied.select(F.explode(F.array(F.struct(F.col("rep").alias("source_id"), F.col("to_rep").alias("target_id")), F.struct(F.col("to_rep").alias("source_id"), F.col("rep").alias("target_id")))).alias("e"))
    return pairs.select("e.*").withColumn("rel_type", F.lit("component_bridge")).withColumn("edge_class", F.lit("bridge"))


def clamped(weight: Column) -> Column:
    return F.greatest(F.lit(0.3), F.least(F.lit(0.8), weight))


def exact_links(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Level 0: given pairs (source_id, target_id, confidence) of two languages."""
    lang = lambda x: nodes.select(F.col("node_id").alias(f"{x}_id"), F.lower(F.coalesce("language", F.lit(""))).alias(f"{x}_lang"))
    both = pairs.join(lang("source"), "source_id").join(lang("target"), "target_id").where("source_lang <> target_lang")
    return both.select("source_id", "target_id", F.lit("cross_language_L0").alias("rel_type"), clamped(F.coalesce("confidence", F.lit(0.8))).alias("weight"))


#: Pairs of nodes of one surface that a task makes, about.
PAIRS_AT_ONCE = 4_000_000


def _surfaced(nodes: DataFrame, surfaces: DataFrame, any_language: bool) -> DataFrame:
    """The surfaces with n (their rows in all) and their nodes' lang and rel_path; only surfaces that have a pair to make."""
    own = surfaces.join(nodes.select("node_id", F.lower(F.coalesce("language", F.lit(""))).alias("lang"), "rel_path"), "node_id")
    size = surfaces.groupBy("kind", "surface").agg(F.count("*").alias("n")).where("n > 1")
    own = written(own.join(size, ["kind", "surface"]), "surfaces")
    if any_language:
        return own
    mixed = own.groupBy("kind", "surface").agg(F.min("lang").alias("_first"), F.max("lang").alias("_last")).where("_first <> _last")
    return own.join(mixed, ["kind", "surface"], "left_semi")


def _surface_pairs(own: DataFrame, any_language: bool, *more: str) -> DataFrame:
    """Pairs a_*, b_* of the rows of equal kind, surface (and ``more``), the smaller node_id first, with their weight.

    Nodes of a surface meet in slices, and slices are dealt to as many tasks as keep each at about PAIRS_AT_ONCE."""
    by = ["kind", "surface", *more]
    sizes = own.groupBy(*by).agg(F.count("*").cast("double").alias("_m")).where("_m > 1")
    sizes = written(sizes.select(*by, "_m", F.ceil(F.col("_m") * F.col("_m") / PAIRS_AT_ONCE).cast("int").alias("_slices")), "sizes")
    whole = sizes.agg(F.sum(F.col("_m") * F.col("_m"))).first()[0] or 0
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, math.ceil(whole / PAIRS_AT_ONCE))
    rows = own.join(sizes, by)
    mine, every = F.pmod(F.xxhash64("node_id"), F.col("_slices")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    rest = [c for c in own.columns if c not in (*by, "n")]
    side = lambda x, which: rows.withColumn("_slice", which).repartition(tasks, *by, "_slice").select(*by, "_slice", *(["n"] if x == "a" else []), *(F.col(c).alias(f"{x}_{c}") for c in rest))
    pairs = side("a", mine).join(side("b", every).hint("merge"), [*by, "_slice"]).where("a_node_id < b_node_id")
    if not any_language:
        pairs = pairs.where("a_lang <> b_lang")
    weight = 0.7 * (F.col("a_hint") + F.col("b_hint")) / 2 * S.locality(F.col("a_rel_path"), F.col("b_rel_path")) / F.log(1.0 + F.col("n"))
    return pairs.withColumn("weight", clamped(weight))


def surface_links(nodes: DataFrame, surfaces: DataFrame, any_language: bool = False) -> DataFrame:
    """Level 1: pairs of nodes that show the same surface (node_id, kind, surface, hint), in two languages unless ``any_language``.

    weight = 0.7 * mean hint * locality / ln(1 + nodes of the surface), within 0.3 and 0.8; the smaller id is the source.
    A surface that very many nodes show makes a pair of each two, as the definition says: the result is that large.
    """
    rel = "api_surface_any_language" if any_language else "cross_language_L1"
    pairs = _surface_pairs(_surfaced(nodes, surfaces, any_language), any_language)
    return pairs.select(F.col("a_node_id").alias("source_id"), F.col("b_node_id").alias("target_id"), F.lit(rel).alias("rel_type"), "weight", "kind", "surface")


def hybrid_links(nodes: DataFrame, fused: DataFrame, threshold: float = 0.02, most: int = 10) -> DataFrame:
    """Level 2: of the ``most`` best fused hits (source_id, target_id, score) those in another language that reach the threshold."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), F.desc("target_id")))
    hits = fused.withColumn("_r", place).where((F.col("_r") <= most) & (F.col("score") >= threshold) & (F.col("source_id") != F.col("target_id")))
    node = lambda x: nodes.select(F.col("node_id").alias(f"{x}_id"), F.lower(F.coalesce("language", F.lit(""))).alias(f"{x}_lang"), F.col("rel_path").alias(f"{x}_path"))
    both = hits.join(node("source"), "source_id").join(node("target"), "target_id").where("source_lang <> target_lang")
    return both.select("source_id", "target_id", F.lit("cross_language_L2").alias("rel_type"), clamped(0.5 * F.col("score") * S.locality(F.col("source_path"), F.col("target_path"))).alias("weight"))


def _members(nodes: DataFrame) -> DataFrame:
    """parent, name, node_id, lang: of each parent's members of one simple name the one of largest id."""
    simple = F.element_at(F.split("symbol_name", r"\."), -1)
    members = nodes.where("parent_symbol IS NOT NULL").select(F.col("parent_symbol").alias("parent"), simple.alias("name"), "node_id", F.lower(F.coalesce("language", F.lit(""))).alias("lang"))
    return members.groupBy("parent", "name").agg(F.max("node_id").alias("node_id"), F.max_by("lang", "node_id").alias("lang"))


def _level3(both: DataFrame, weight: Column) -> DataFrame:
    return both.groupBy(F.col("a_node").alias("source_id"), F.col("b_node").alias("target_id")).agg(clamped(0.6 * F.max(weight)).alias("weight")).select("source_id", "target_id", F.lit("cross_language_L3").alias("rel_type"), "weight")


def _member_pairs(members: DataFrame, parents: DataFrame) -> DataFrame:
    side = lambda x, of: members.select(F.col("parent").alias(of), "name", F.col("node_id").alias(f"{x}_node"), F.col("lang").alias(f"{x}_lang"))
    return parents.join(side("a", "source_id"), "source_id").join(side("b", "target_id"), ["target_id", "name"]).where("a_node <> b_node AND a_lang <> b_lang")


def member_links(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Level 3: members of one simple name of two linked parents (source_id, target_id, weight), in two languages: 0.6 * weight."""
    return _level3(_member_pairs(_members(nodes), parents), F.col("weight"))


def member_links_of_groups(nodes: DataFrame, groups: DataFrame, weight: float) -> DataFrame:
    """Level 3 where all nodes of equal keys in ``groups(node_id, key columns)`` are linked with ``weight``, the smaller id first.

    Members meet by their parents' keys and their own name, so no pair of parents is made; where all of them are of one language
    nothing is."""
    keys = [c for c in groups.columns if c != "node_id"]
    own = written(_members(nodes).join(groups.withColumnRenamed("node_id", "parent"), "parent"), "members")
    by = [*keys, "name"]
    mixed = own.groupBy(*by).agg(F.min("lang").alias("first"), F.max("lang").alias("last")).where("first <> last").select(*by)
    own = own.join(mixed, by)
    side = lambda x: own.select(*by, *(F.col(c).alias(f"{x}_{n}") for c, n in (("parent", "parent"), ("node_id", "node"), ("lang", "lang"))))
    both = side("a").join(side("b"), by).where("a_parent < b_parent AND a_lang <> b_lang AND a_node <> b_node")
    return _level3(both, F.lit(weight))


def cross_language(nodes: DataFrame, given: DataFrame, surfaces: DataFrame, fused: DataFrame) -> DataFrame:
    """All four levels, each (source_id, target_id, rel_type) once.

    A pair of level 1 comes twice only if both nodes have several surfaces, so only such pairs are shuffled to be made one.
    Members of parents with a surface in common meet by that surface and their name, not over the pairs of their parents."""
    kept = ("source_id", "target_id", "rel_type", "weight")
    once = lambda links: links.groupBy("source_id", "target_id", "rel_type").agg(F.max("weight").alias("weight"))
    own = _surfaced(nodes, surfaces, False)
    own = written(own.join(own.groupBy("node_id").agg((F.count("*") > 1).alias("several")), "node_id"), "surfaces")
    alike = _surface_pairs(own, False).withColumn("_again", F.col("a_several") & F.col("b_several"))
    alike = alike.select(F.col("a_node_id").alias("source_id"), F.col("b_node_id").alias("target_id"), F.lit("cross_language_L1").alias("rel_type"), "weight", "_again")
    links = written(once(exact_links(nodes, given).select(*kept).union(hybrid_links(nodes, fused).select(*kept))), "links")
    members = _members(nodes)
    held = written(own.join(members.select(F.col("parent").alias("node_id"), "name", F.col("node_id").alias("member"), F.col("lang").alias("member_lang")), "node_id"), "members")
    met = _surface_pairs(held, False, "name").where("a_member <> b_member AND a_member_lang <> b_member_lang")
    met = met.select(F.col("a_member").alias("a_node"), F.col("b_member").alias("b_node"), "weight")
    both = met.union(_member_pairs(members, links).select("a_node", "b_node", "weight"))
    several = alike.where("_again").select(*kept) if not own.where("several").isEmpty() else None
    found = links.select(*kept).union(alike.where("NOT _again").select(*kept)).union(_level3(both, F.col("weight")))
    return found.union(once(several).select(*kept)) if several is not None else found
