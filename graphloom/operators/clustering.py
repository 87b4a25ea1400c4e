"""Sections and pages of a code graph: projection, communities, merging to caps, page sizes, hubs.

Communities and folds work on contracted graphs (files, directories, clusters): hundreds to thousands of rows that
aggregations over the whole graph give.  Those folds run in one task per scope (a repository or a section), whose size is
checked against ``MOST_IN_SCOPE``; node-level work stays in joins and aggregations.  A section's communities are split by a
task each; beyond FILE_PAIRS and SEQUENTIAL_PAIRS communities are found by rounds over all sections.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.components import components
from graphloom.operators.expand import louvain, louvain_numbers
from graphloom.operators.graph import contracted, undirected
from graphloom.operators.leiden import leiden, numbered
from graphloom.operators.linkage import bridges
from graphloom.sources.shared import written

#: Rows of one scope's contracted graph, at most; beyond it contract further (files to directories).
MOST_IN_SCOPE = 5_000_000
#: Types that belong to a parent, sizes of pages, weight of a bridge.
CHILD_TYPES = ("method", "constructor", "field", "variable", "property", "parameter", "attribute")
LEAST_PAGE, MOST_PAGE, BRIDGE_WEIGHT = 4, 60, 0.1


def checked(rows: DataFrame, scope: str) -> DataFrame:
    """The rows, written; an error if a scope has more than one task should take."""
    rows = written(rows, "scope")
    most = rows.groupBy(scope).count().agg(F.max("count")).first()[0] or 0
    if most > MOST_IN_SCOPE:
        raise ValueError(f"{most} rows in one {scope}: contract the graph further")
    return rows


def parents(nodes: DataFrame) -> DataFrame:
    """node_id and parent: what a node is projected to, itself unless it is a child whose parent is known.

    ``parent_symbol`` holds the parent's id, or its name in the same file."""
    own = nodes.select("node_id", F.lower("symbol_type").alias("kind"), "parent_symbol", "rel_path", "symbol_name")
    child = F.col("kind").isin(*CHILD_TYPES)
    by_id = own.select(F.col("node_id").alias("parent_symbol"), F.col("node_id").alias("by_id"))
    by_name = own.where(~child).groupBy("rel_path", F.col("symbol_name").alias("parent_symbol")).agg(F.max("node_id").alias("by_name"))
    rows = own.join(by_id, "parent_symbol", "left").join(by_name, ["rel_path", "parent_symbol"], "left")
    return rows.select("node_id", F.when(child, F.coalesce("by_id", "by_name", "node_id")).otherwise(F.col("node_id")).alias("parent"))


def projected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between parents: ends mapped, loops dropped, parallel edges kept with all their columns."""
    p = parents(nodes)
    side = lambda of: p.select(F.col("node_id").alias(of), F.col("parent").alias(f"_{of}"))
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    both = edges.join(side("source_id"), "source_id").join(side("target_id"), "target_id").where("_source_id <> _target_id")
    return both.select(F.col("_source_id").alias("source_id"), F.col("_target_id").alias("target_id"), *rest)


def affinity(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """a < b, weight: the summed weight of edges between clusters of ``assigned(node_id, cluster)``."""
    side = lambda x, of: assigned.select(F.col("node_id").alias(of), F.col("cluster").alias(x))
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    both = edges.withColumn("_w", weight).join(side("ca", "source_id"), "source_id").join(side("cb", "target_id"), "target_id").where("ca <> cb")
    return both.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("_w").alias("weight"))


def fold_to_cap(sizes: dict[int, int], links: dict[tuple[int, int], float], cap: int) -> dict[int, int]:
    """Old cluster to new: the smallest goes to the neighbour of highest affinity (the larger of equals) until ``cap`` are left;
    numbered by size."""
    sizes, into = dict(sizes), {c: c for c in sizes}
    near: dict[int, Counter] = {c: Counter() for c in sizes}
    for (a, b), w in links.items():
        near[a][b] += w
        near[b][a] += w
    while len(sizes) > cap:
        small = min(sizes, key=lambda c: (sizes[c], c))
        best = max((c for c in sizes if c != small), key=lambda c: (near[small][c], sizes[c], -c))
        sizes[best] += sizes.pop(small)
        for c, w in near.pop(small).items():
            near[c].pop(small, None)
            if c != best:
                near[best][c] += w
                near[c][best] += w
        into = {k: best if v == small else v for k, v in into.items()}
    order = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))}
    return {k: order[v] for k, v in into.items()}


def merged_to_cap(edges: DataFrame, assigned: DataFrame, cap: int, scope: str | None = None) -> DataFrame:
    """node_id and cluster after clusters (of a scope, if given) are merged until ``cap`` are left."""
    scope_of = assigned if scope else assigned.withColumn("_all", F.lit(0))
    key = scope or "_all"
    unique = scope_of.select("node_id", key, F.concat_ws("\x1f", F.col(key).cast("string"), F.col("cluster").cast("string")).alias("cluster"))
    links = affinity(edges, unique.select("node_id", "cluster"))
    left = lambda c: F.split(c, "\x1f")
    links = links.where(left("a")[0] == left("b")[0]).select(left("a")[0].alias(key), left("a")[1].cast("int").alias("a"), left("b")[1].cast("int").alias("b"), "weight", F.lit(0).cast("long").alias("size"))
    counts = scope_of.groupBy(F.col(key).cast("string").alias(key), F.col("cluster").cast("int").alias("a")).agg(F.count("*").alias("size")).select(key, "a", F.lit(-1).alias("b"), F.lit(0.0).alias("weight"), "size")
    rows = checked(counts.union(links.select(key, "a", "b", "weight", "size")), key)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, pairs = frame[frame.b < 0], frame[frame.b >= 0]
        into = fold_to_cap(dict(zip(own.a, own["size"], strict=True)), {(a, b): w for a, b, w in pairs[["a", "b", "weight"]].itertuples(index=False)}, cap)
        return pd.DataFrame({key: frame[key].iloc[0], "a": list(into), "now": list(into.values())})

    into = rows.groupBy(key).applyInPandas(run, f"{key} string, a int, now int")
    out = scope_of.select("node_id", F.col(key).alias("_k"), F.col(key).cast("string").alias(key), F.col("cluster").cast("int").alias("a")).join(into, [key, "a"])
    return out.select("node_id", *([F.col("_k").alias(scope)] if scope else []), F.col("now").alias("cluster"))


def similarity_fold(sizes: dict[int, int], histograms: dict[int, Counter], target: int) -> dict[int, int]:
    """Old section to new: the smallest goes to the one that shares most of its directories (the smaller of equals) until ``target`` are left."""
    sizes, hist, into = dict(sizes), {k: Counter(v) for k, v in histograms.items()}, {c: c for c in sizes}
    while len(sizes) > target:
        small = min(sizes, key=lambda c: (sizes[c], c))
        shared = lambda c: sum((hist[small] & hist[c]).values())  # noqa: B023, E731
        best = max((c for c in sizes if c != small), key=lambda c: (shared(c), -sizes[c], -c))
        sizes[best] += sizes.pop(small)
        hist[best] += hist.pop(small)
        into = {k: best if v == small else v for k, v in into.items()}
    return into


def consolidated(nodes: DataFrame, assigned: DataFrame, target: int, scope: str | None = None) -> DataFrame:
    """node_id and cluster: clusters (of a scope) merged by shared directories until ``target`` are left."""
    key = scope or "_all"
    own = assigned if scope else assigned.withColumn("_all", F.lit("all"))
    hist = own.join(nodes.select("node_id", S.directory(F.col("rel_path")).alias("dir")), "node_id").groupBy(key, "cluster", "dir").count()
    hist = checked(hist, key)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        histograms = {int(c): Counter(dict(zip(g["dir"], g["count"].astype(int), strict=True))) for c, g in frame.groupby("cluster")}
        into = similarity_fold({c: sum(h.values()) for c, h in histograms.items()}, histograms, target)
        return pd.DataFrame({key: frame[key].iloc[0], "cluster": list(into), "now": list(into.values())})

    kinds = dict(own.dtypes)
    into = hist.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, cluster {kinds['cluster']}, now int")
    return own.join(into, [key, "cluster"]).select("node_id", *([scope] if scope else []), F.col("now").alias("cluster"))


def file_chunks(nodes: DataFrame, most: int = MOST_PAGE, scope: str = "rel_path") -> DataFrame:
    """node_id, scope and chunk: the nodes of a file in order of lines, ``most`` to a chunk."""
    by = Window.partitionBy(scope).orderBy(F.coalesce("start_line", F.lit(0)), "node_id")
    return nodes.select("node_id", F.coalesce(scope, F.lit("")).alias(scope), "start_line").withColumn("chunk", F.floor((F.row_number().over(by) - 1) / most).cast("int")).select("node_id", scope, "chunk")


def scope_chunks(nodes: DataFrame, most: int = 50) -> DataFrame:
    """node_id, rel_path, part: a file of more than ``most`` nodes is split by the scopes of its symbols, and scopes by lines.

    With one scope alone, or few nodes, lines or nothing split it."""
    scope = F.coalesce(F.when(F.col("parent_symbol") != "", F.col("parent_symbol")), F.lit("__toplevel__"))
    in_file, in_scope = Window.partitionBy("rel_path"), Window.partitionBy("rel_path", "scope").orderBy(F.coalesce("start_line", F.lit(0)), "node_id")
    rows = nodes.select("node_id", "rel_path", "start_line", scope.alias("scope")).withColumn("n", F.count("*").over(in_file)).withColumn("k", F.floor((F.row_number().over(in_scope) - 1) / most).cast("int"))
    return rows.select("node_id", "rel_path", F.when(F.col("n") <= most, F.lit("")).otherwise(F.concat_ws("#", "scope", F.col("k").cast("string"))).alias("part"))


def split(nodes: list[str], pairs: list[tuple[str, str, float]], where: dict[str, tuple[str, int]], most: int, resolution: float = 2.0) -> list[list[str]]:
    """Groups of at most ``most`` nodes: communities at rising resolution; where they do not come apart, chunks of files by lines."""
    if len(nodes) <= most:
        return [sorted(nodes)]
    inside = set(nodes)
    own = [(a, b, w) for a, b, w in pairs if a in inside and b in inside]
    found = louvain(iter(own), resolution) if own else {}
    lone = max(found.values(), default=-1) + 1
    groups: dict[int, list[str]] = {}
    for i, v in enumerate(sorted(nodes)):
        groups.setdefault(found.get(v, lone + i), []).append(v)
    if not own or len(groups) <= 1:
        by_file: dict[str, list[str]] = {}
        for v in sorted(nodes, key=lambda v: (where[v][0], where[v][1], v)):
            by_file.setdefault(where[v][0], []).append(v)
        return [vs[i : i + most] for vs in by_file.values() for i in range(0, len(vs), most)]
    inner = _inner({v: g for g, vs in groups.items() for v in vs}, own)
    return [part for g, vs in groups.items() for part in split(vs, inner.get(g, []), where, most, resolution + 0.5)]


def _inner(of: dict[str, int], pairs: list[tuple[str, str, float]]) -> dict[int, list[tuple[str, str, float]]]:
    """The pairs inside each group, in one pass."""
    inner: dict[int, list[tuple[str, str, float]]] = {}
    for pair in pairs:
        g = of.get(pair[0])
        if g is not None and g == of.get(pair[1]):
            inner.setdefault(g, []).append(pair)
    return inner


def grown(clusters: dict[int, list[str]], pairs: list[tuple[str, str, float]], least: int = LEAST_PAGE) -> dict[int, list[str]]:
    """Clusters below ``least`` go to the cluster they are most tied to (the largest, if to none)."""
    clusters = {c: list(v) for c, v in clusters.items()}
    of = {v: c for c, vs in clusters.items() for v in vs}
    near: dict[int, Counter] = {c: Counter() for c in clusters}
    for a, b, w in pairs:
        ca, cb = of.get(a), of.get(b)
        if ca is not None and cb is not None and ca != cb:
            near[ca][cb] += w
            near[cb][ca] += w
    while len(clusters) > 1 and (small := [c for c in sorted(clusters) if len(clusters[c]) < least]):
        for c in small:
            if len(clusters) == 1 or len(clusters[c]) >= least:
                continue
            tied = [x for x, w in near[c].items() if w > 0] or [x for x in clusters if x != c]
            best = max(tied, key=lambda x: (near[c][x], len(clusters[x]), -x))
            clusters[best] += clusters.pop(c)
            for x, w in near.pop(c).items():
                near[x].pop(c, None)
                if x != best:
                    near[best][x] += w
                    near[x][best] += w
    return clusters


def sized(clusters: dict[int, list[str]], pairs: list[tuple[str, str, float]], where: dict[str, tuple[str, int]], least: int = LEAST_PAGE, most: int = MOST_PAGE) -> dict[str, int]:
    """Node to page: clusters below ``least`` are joined to others (``grown``), those above ``most`` are split."""
    clusters = grown(clusters, pairs, least)
    inner = _inner({v: c for c, vs in clusters.items() for v in vs}, pairs)
    groups = [part for c in sorted(clusters) for part in split(clusters[c], inner.get(c, []), where, most)]
    return {v: i for i, g in enumerate(groups) for v in g}


#: Graphs of up to so many pairs are clustered in one task, larger ones by rounds over the cluster, which take some seconds each
#: whatever the size: a file graph by numbers (arrays of some 100 bytes a pair), a section or a community of one with its pairs and
#: nodes by name.
FILE_PAIRS, SEQUENTIAL_PAIRS = 12_000_000, 1_500_000
#: Parts to which sections and their communities are dealt, many more than there are tasks at once, so that few meet in one.
PARTS = 256


def pages(nodes: DataFrame, edges: DataFrame, sections: DataFrame, resolution: float = 1.0, least: int = LEAST_PAGE, most: int = MOST_PAGE) -> DataFrame:
    """node_id, section, page: communities inside each section (below four nodes one page), then sized.

    The communities of a section of up to SEQUENTIAL_PAIRS pairs and nodes are found by one task, and each is split by a task of its
    own; those of larger sections are found by rounds (``_wide_pages``)."""
    side = lambda of: sections.select(F.col("node_id").alias(of), F.col("cluster").alias(f"s_{of}"))
    inner = edges.join(side("source_id"), "source_id").join(side("target_id"), "target_id").where("s_source_id = s_target_id")
    weight = F.sum("weight") if "weight" in edges.columns else F.count("*").cast("double")
    pairs = inner.groupBy(F.col("s_source_id").alias("section"), F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(weight.alias("weight"))
    alone = sections.join(nodes.select("node_id", "rel_path", F.coalesce("start_line", F.lit(0)).alias("line")), "node_id").select(F.col("cluster").alias("section"), F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight"), "rel_path", "line")
    rows = written(pairs.select("section", "a", "b", F.col("weight").cast("double").alias("weight"), F.lit("").alias("rel_path"), F.lit(0).alias("line")).union(alone), "scope")
    sizes = written(rows.groupBy("section").count().select("section", (F.col("count") > SEQUENTIAL_PAIRS).alias("wide")), "sizes")
    of = lambda wide: rows.join(F.broadcast(sizes.where("wide" if wide else "NOT wide")), "section", "left_semi")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame.b.isna()].sort_values("a")
        links = list(frame[frame.b.notna()].sort_values(["a", "b"])[["a", "b", "weight"]].itertuples(index=False, name=None))
        found = louvain(iter(links), resolution) if links and len(own) >= 4 else {}
        clusters: dict[int, list[str]] = {}
        for v in own.a:
            clusters.setdefault(found.get(v, -1), []).append(v)
        # names of groups in the order of their numbers
        of = {v: f"{c + 1:09d}" for c, vs in grown(clusters, links, least).items() for v in vs}
        frame = frame.assign(group=frame.a.map(of))
        return frame[frame.b.isna() | (frame.group == frame.b.map(of))][["section", "group", "a", "b", "weight", "rel_path", "line"]]

    held = of(False).repartition(PARTS, "section").groupBy("section").applyInPandas(run, "section int, group string, a string, b string, weight double, rel_path string, line int")
    narrow = _numbered_pages(_split_in_tasks(held, most, 2.0))
    if sizes.where("wide").isEmpty():
        return narrow
    wide = of(True)
    own = wide.where("b IS NULL").select("section", F.col("a").alias("node_id"), F.coalesce("rel_path", F.lit("")).alias("rel_path"), "line")
    return narrow.union(_wide_pages(own, wide.where("b IS NOT NULL").select("section", "a", "b", "weight"), resolution, least, most))


def _within(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """section, a, b, weight and the groups ga and gb of both ends in ``placed(section, node_id, group)``; pairs without a placed end drop."""
    side = lambda end, g: placed.select("section", F.col("node_id").alias(end), F.col("group").alias(g))
    return pairs.join(side("a", "ga"), ["section", "a"]).join(side("b", "gb"), ["section", "b"])


def _grown(placed: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Groups below ``least`` joined to the group of their section they are most tied to (the largest, if to none), until none is left
    but where a section has one group alone."""
    while True:
        sizes = written(placed.groupBy("section", "group").agg(F.count("*").alias("n")), "sizes")
        groups = sizes.groupBy("section").agg(F.count("*").alias("groups"))
        small = written(sizes.where(F.col("n") < least).join(groups.where("groups > 1").select("section"), "section").select("section", "group"), "small")
        if small.isEmpty():
            return placed
        met = _within(pairs, placed).where("ga <> gb")
        ways = met.select("section", F.col("ga").alias("group"), F.col("gb").alias("to"), "weight").union(met.select("section", "gb", "ga", "weight"))
        ties = ways.join(small, ["section", "group"], "left_semi").groupBy("section", "group", "to").agg(F.sum("weight").alias("w"))
        ties = ties.join(sizes.withColumnRenamed("group", "to"), ["section", "to"])
        best = ties.groupBy("section", "group").agg(F.min_by("to", F.struct(-F.col("w"), -F.col("n"), F.col("to"))).alias("to"))
        # the two largest of a section: a group that is tied to none goes to the first that is not itself
        order = F.struct((-F.col("n")).alias("n"), F.col("group").alias("g"))
        first = sizes.groupBy("section").agg(F.min(order).alias("first"))
        second = sizes.join(first, "section").where("group <> first.g").groupBy("section", "first").agg(F.min(order).alias("second"))
        to = small.join(best, ["section", "group"], "left").join(second, "section")
        to = to.select("section", "group", F.coalesce("to", F.when(F.col("group") == F.col("first.g"), F.col("second.g")).otherwise(F.col("first.g"))).alias("to"))
        key = lambda g: F.struct(F.col("section").alias("s"), F.col(g).alias("g"))
        joined = components(to.select(key("group").alias("a"), key("to").alias("b"))).select(F.col("node.s").alias("section"), F.col("node.g").alias("group"), F.col("component.g").alias("now"))
        placed = written(placed.join(joined, ["section", "group"], "left").withColumn("group", F.coalesce("now", "group")).drop("now"), "grown")


def _wide_pages(own: DataFrame, pairs: DataFrame, resolution: float, least: int, most: int) -> DataFrame:
    """Pages of sections that are too large for a task: ``own(section, node_id, rel_path, line)``, ``pairs(section, a, b, weight)``.

    Communities by rounds over all sections, small ones joined, and large ones split: a community within SEQUENTIAL_PAIRS in a task
    of its own, a larger one by rounds at rising resolution, or by lines of its files where it does not come apart."""
    found = leiden(pairs.select("section", "a", "b", "weight").withColumnRenamed("section", "scope"), resolution)
    placed = own.join(found.select(F.col("scope").alias("section"), F.col("node").alias("node_id"), F.col("community").alias("group")), ["section", "node_id"], "left")
    placed = _grown(written(placed.withColumn("group", F.coalesce("group", F.lit(""))), "placed"), pairs, least)
    done, rising = [], 2.0
    while True:
        inner = written(_within(pairs, placed).where("ga = gb").select("section", F.col("ga").alias("group"), "a", "b", "weight"), "inner")
        counts = placed.groupBy("section", "group").agg(F.count("*").alias("n")).join(inner.groupBy("section", "group").agg(F.count("*").alias("m")), ["section", "group"], "left")
        m = F.coalesce("m", F.lit(0))
        kind = F.when(F.col("n") <= most, "whole").when(m == 0, "chunks").when(m + F.col("n") <= SEQUENTIAL_PAIRS, "task").otherwise("rounds")
        kinds = written(counts.select("section", "group", kind.alias("kind")), "kinds")
        of = lambda rows, k, kinds=kinds: rows.join(kinds.where(F.col("kind") == k).select("section", "group"), ["section", "group"], "left_semi")
        done.append(of(placed, "whole").select("section", "node_id", F.concat_ws("\x1f", "group", F.lit("")).alias("part")))
        done.append(_lines(of(placed, "chunks"), most))
        nodes = of(placed, "task").select("section", "group", F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight"), "rel_path", "line")
        done.append(_split_in_tasks(nodes.union(of(inner, "task").select("section", "group", "a", "b", "weight", F.lit(""), F.lit(0))), most, rising))
        rest = written(of(placed, "rounds"), "rest")
        if rest.isEmpty():
            break
        name = F.struct("section", "group")
        apart = leiden(of(inner, "rounds").select(name.alias("scope"), "a", "b", "weight"), rising)
        apart = apart.select(F.col("scope.section").alias("section"), F.col("scope.group").alias("group"), F.col("node").alias("node_id"), "community")
        # a node without a link is a group of its own
        parted = written(rest.join(apart, ["section", "group", "node_id"], "left").withColumn("community", F.coalesce("community", "node_id")), "parted")
        whole = parted.groupBy("section", "group").agg((F.min("community") == F.max("community")).alias("whole"))
        parted = parted.join(whole, ["section", "group"])
        done.append(_lines(parted.where("whole"), most))
        placed = written(parted.where("NOT whole").select("section", "node_id", "rel_path", "line", F.concat_ws("\x1e", "group", "community").alias("group")), "placed")
        pairs, rising = of(inner, "rounds").select("section", "a", "b", "weight"), rising + 0.5
    return _numbered_pages(reduce(DataFrame.unionByName, done))


def _numbered_pages(parts: DataFrame) -> DataFrame:
    """node_id, section, page of ``parts(section, node_id, part)``: parts of a section numbered in their order."""
    parts = written(parts, "parts")
    number = F.row_number().over(Window.partitionBy("section").orderBy("part")) - 1
    return parts.join(parts.select("section", "part").distinct().withColumn("page", number), ["section", "part"]).select("node_id", "section", F.col("page").cast("int").alias("page"))


def _lines(placed: DataFrame, most: int) -> DataFrame:
    """section, node_id, part: the nodes of each group and file in order of lines, ``most`` to a part."""
    by = Window.partitionBy("section", "group", "rel_path").orderBy("line", "node_id")
    chunk = F.floor((F.row_number().over(by) - 1) / most).cast("string")
    return placed.select("section", "node_id", F.concat_ws("\x1f", "group", "rel_path", chunk).alias("part"))


def _split_in_tasks(rows: DataFrame, most: int, resolution: float) -> DataFrame:
    """section, node_id, part: ``split`` of each group, groups in parallel; rows are nodes (``a``, without ``b``) and pairs of a group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame.b.isna()]
        links = list(frame[frame.b.notna()].sort_values(["a", "b"])[["a", "b", "weight"]].itertuples(index=False, name=None))
        where = {a: (p, int(n)) for a, p, n in own[["a", "rel_path", "line"]].itertuples(index=False)}
        found = [(v, f"{frame.group.iloc[0]}\x1f{i:09d}") for i, g in enumerate(split(list(where), links, where, most, resolution)) for v in g]
        return pd.DataFrame({"section": frame.section.iloc[0], "node_id": [v for v, _ in found], "part": [p for _, p in found]})

    return rows.repartition(PARTS, "section", "group").groupBy("section", "group").applyInPandas(run, "section int, node_id string, part string")


def _file_communities(files: DataFrame, resolution: float) -> DataFrame:
    """scope, node, number of the communities of each scope's graph, a scope in a task, where nodes are numbers in the order of their names."""
    ends = files.select("scope", F.col("a").alias("node")).union(files.select("scope", "b")).distinct()
    ids = written(ends.orderBy("scope", "node").select("scope", "node", F.monotonically_increasing_id().alias("id")), "ids")
    end = lambda c: ids.select("scope", F.col("node").alias(c), F.col("id").alias(f"_{c}"))
    pairs = files.join(end("a"), ["scope", "a"]).join(end("b"), ["scope", "b"]).select("scope", F.col("_a").alias("u"), F.col("_b").alias("v"), "weight")

    def run(table: pa.Table) -> pa.Table:
        pairs = np.array([table.column(c).to_numpy() for c in ("u", "v")])
        known, at = np.unique(pairs, return_inverse=True)
        u, v = at.reshape(2, -1).astype(np.int32)
        w = table.column("weight").to_numpy()
        order = np.lexsort((v, u))
        found = louvain_numbers(len(known), u[order], v[order], w[order], resolution)
        return pa.table({"id": known, "community": known[np.unique(found, return_index=True)[1]][np.unique(found, return_inverse=True)[1]]})

    found = pairs.groupBy("scope").applyInArrow(run, "id long, community long")
    first = ids.select(F.col("id").alias("community"), F.col("node").alias("first"))
    return numbered(ids.join(found, "id").join(first, "community").select("scope", "node", F.col("first").alias("community")))


def sections(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node_id and cluster: communities of the file graph; files without an edge go where most of their directory's files are
    (the smallest section of equals), or, if there are none, get a section each."""
    files = written(contracted(nodes, edges, lambda p: p).select(F.lit("all").alias("scope"), "a", "b", F.col("weight").cast("double").alias("weight")), "file-graph")
    found = _file_communities(files, resolution) if files.count() <= FILE_PAIRS else numbered(leiden(files, resolution))
    placed = written(found.select(F.col("node").alias("rel_path"), F.col("number").alias("cluster")), "sections")
    lone = nodes.select("rel_path").distinct().join(placed, "rel_path", "left_anti").withColumn("dir", S.directory(F.col("rel_path")))
    votes = placed.groupBy(S.directory(F.col("rel_path")).alias("dir"), "cluster").count().groupBy("dir").agg(F.max_by("cluster", F.struct("count", -F.col("cluster"))).alias("cluster"))
    some = placed.agg(F.min("cluster").alias("first"))
    own = F.dense_rank().over(Window.orderBy("rel_path")) - 1
    near = lone.join(votes, "dir", "left").crossJoin(F.broadcast(some)).select("rel_path", F.coalesce("cluster", "first", own).alias("cluster"))
    return nodes.select("node_id", "rel_path").join(placed.union(near), "rel_path").select("node_id", "cluster")


def hub_places(edges: DataFrame, placed: DataFrame, hubs: DataFrame) -> DataFrame:
    """node_id, section, page of hubs: where most of their neighbours are (``placed(node_id, section, page)``), section first and
    page within it; the largest if they have none there."""
    arcs = edges.select(F.col("source_id").alias("hub"), F.col("target_id").alias("node_id")).union(edges.select("target_id", "source_id"))
    votes = arcs.join(hubs.select(F.col("node_id").alias("hub")), "hub", "left_semi").join(placed, "node_id")
    section = votes.groupBy("hub", "section").count().groupBy("hub").agg(F.max_by("section", F.struct("count", -F.col("section"))).alias("voted"))
    sizes = placed.groupBy("section").count().agg(F.max_by("section", F.struct("count", -F.col("section"))).alias("largest"))
    own = hubs.select(F.col("node_id").alias("hub")).join(section, "hub", "left").crossJoin(F.broadcast(sizes)).select("hub", F.coalesce("voted", "largest").alias("section"))
    page = votes.groupBy("hub", "section", "page").count().groupBy("hub", "section").agg(F.max_by("page", F.struct("count", -F.col("page"))).alias("voted"))
    biggest = placed.groupBy("section", "page").count().groupBy("section").agg(F.max_by("page", F.struct("count", -F.col("page"))).alias("biggest"))
    return own.join(page, ["hub", "section"], "left").join(biggest, "section", "left").select(F.col("hub").alias("node_id"), "section", F.coalesce("voted", "biggest").alias("page"))


def bridged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A projected graph with its components tied by directories, at BRIDGE_WEIGHT."""
    tied = bridges(nodes, edges).select("source_id", "target_id", F.lit(BRIDGE_WEIGHT).alias("weight"))
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return edges.select("source_id", "target_id", weight.alias("weight")).union(tied)


def clustered(nodes: DataFrame, edges: DataFrame, hubs: DataFrame, section_resolution: float = 1.0, page_resolution: float = 1.0) -> DataFrame:
    """node_id, section, page of every node: projected, without hubs into sections (merged by directories to
    ceil(1.2 log2 files)) and pages, then children to their parents' place and hubs to their neighbours'."""
    placed_at = parents(nodes)
    kept = nodes.join(placed_at.select(F.col("parent").alias("node_id")).distinct(), "node_id", "left_semi")
    core = kept.join(hubs.select("node_id"), "node_id", "left_anti")
    graph = projected(nodes, edges)
    ends = core.select("node_id")
    inner = graph.join(ends.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    inner = written(bridged(core, inner), "projected")
    files = core.select("rel_path").distinct().count()
    target = 5 if files < 10 else max(5, min(20, math.ceil(1.2 * math.log2(max(10, files)))))
    found = written(consolidated(core, sections(core, inner, section_resolution), target), "sections")
    paged = written(pages(core, inner, found, page_resolution), "pages")
    every = paged.unionByName(hub_places(graph, paged, kept.join(hubs.select("node_id"), "node_id", "left_semi")).select("node_id", "section", "page"))
    return placed_at.join(every.withColumnRenamed("node_id", "parent"), "parent").select("node_id", "section", "page")


def persisted(nodes: DataFrame, placed: DataFrame, hubs: DataFrame) -> DataFrame:
    """The nodes with macro_cluster, micro_cluster, is_hub and hub_assignment made anew: nothing of an earlier run stays."""
    rest = [c for c in nodes.columns if c not in ("macro_cluster", "micro_cluster", "is_hub", "hub_assignment")]
    rows = nodes.select(*rest).join(placed.select("node_id", F.col("section").alias("macro_cluster"), F.col("page").alias("micro_cluster")), "node_id", "left")
    rows = rows.join(hubs.select("node_id", F.lit(True).alias("_hub")), "node_id", "left")
    return rows.withColumn("is_hub", F.coalesce("_hub", F.lit(False))).withColumn("hub_assignment", F.when(F.col("is_hub"), F.col("macro_cluster").cast("string"))).drop("_hub")


def central_symbols(nodes: DataFrame, edges: DataFrame, page: str, k: int = 5, damping: float = 0.85) -> DataFrame:
    """page, node_id, rank: the ``k`` nodes of highest PageRank in each page's undirected weighted graph (ties by id).

    A page's graph is small by its size rule; pages run in parallel."""
    side = lambda of: nodes.select(F.col("node_id").alias(of), F.col(page).alias(f"p_{of}"))
    both = edges.join(side("source_id"), "source_id").join(side("target_id"), "target_id").where("p_source_id = p_target_id")
    pairs = undirected(both, "weight" if "weight" in edges.columns else None)
    pairs = pairs.join(nodes.select(F.col("node_id").alias("a"), page), "a").select(page, "a", "b", F.col("weight").cast("double").alias("weight"))
    alone = nodes.select(page, F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight")).where(F.col(page).isNotNull())
    rows = checked(pairs.union(alone), page)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame[frame.b.isna()].a))
        at = {v: i for i, v in enumerate(names)}
        arcs: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
        for a, b, w in frame[frame.b.notna()][["a", "b", "weight"]].itertuples(index=False):
            arcs[at[a]][at[b]] = arcs[at[a]].get(at[b], 0) + w
            if a != b:
                arcs[at[b]][at[a]] = arcs[at[b]].get(at[a], 0) + w
        n = len(names)
        x = [1 / n] * n
        for _ in range(100):
            loose = sum(x[i] for i in range(n) if not arcs[i])
            new = [(1 - damping) / n + damping * loose / n] * n
            for i, out in arcs.items():
                total = sum(out.values())
                for j, w in out.items():
                    new[j] += damping * x[i] * w / total
            done = sum(abs(u - v) for u, v in zip(new, x, strict=True)) < n * 1e-6
            x = new
            if done:
                break
        best = sorted(range(n), key=lambda i: (-round(x[i], 9), names[i]))[:k]
        return pd.DataFrame({page: frame[page].iloc[0], "node_id": [names[i] for i in best], "rank": range(1, len(best) + 1)})

    return rows.groupBy(page).applyInPandas(run, f"{page} {dict(rows.dtypes)[page]}, node_id string, rank int")


def directory_communities(coupling: DataFrame, counts: DataFrame, budget: int) -> DataFrame:
    """dir and cluster: communities of directories (a, b, weight) at the resolution whose number is nearest to ``budget``."""
    rows = checked(coupling.select(F.lit("all").alias("scope"), "a", "b", F.col("weight").cast("double").alias("weight")).union(counts.select(F.lit("all"), F.col("dir"), F.lit(None).cast("string"), F.lit(0.0))), "scope")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame[frame.b.isna()].a))
        links = list(frame[frame.b.notna()].sort_values(["a", "b"])[["a", "b", "weight"]].itertuples(index=False, name=None))
        best, miss = {}, math.inf
        for resolution in (0.5, 0.7, 1.0, 1.3, 1.6, 2.0, 2.5, 3.0):
            found = louvain(iter(links), resolution)
            lone = max(found.values(), default=-1) + 1
            found |= {v: lone + i for i, v in enumerate(v for v in names if v not in found)}
            off = abs(len(set(found.values())) - budget)
            if off < miss:
                best, miss = found, off
            if off <= max(3, budget * 0.2):
                break
        return pd.DataFrame({"dir": list(best), "cluster": list(best.values())})

    return rows.groupBy("scope").applyInPandas(run, "dir string, cluster int")


def normalized(clusters: list[list[str]], count: dict[str, int], least: int = 10, most: int = 40) -> list[list[str]]:
    """Clusters of directories: large ones dealt to the lightest of ceil(n / most) groups, small ones to the cluster that shares
    most parents and stays within 1.5 * most."""
    parent = lambda d: d.rpartition("/")[0] or "<root>"
    total = lambda dirs: sum(count.get(d, 0) for d in dirs)
    normal, small = [], []
    for dirs in clusters:
        n = total(dirs)
        if n > most and len(dirs) > 1:
            groups: list[list[str]] = [[] for _ in range(max(2, math.ceil(n / most)))]
            for d in sorted(dirs, key=lambda d: (-count.get(d, 0), d)):
                min(groups, key=total).append(d)
            normal += [g for g in groups if g]
        else:
            (small if n < least else normal).append(list(dirs))
    for dirs in small:
        own = set(map(parent, dirs))
        fits = [i for i, g in enumerate(normal) if total(g) + total(dirs) <= most * 1.5]
        if fits:
            normal[max(fits, key=lambda i: (len(own & set(map(parent, normal[i]))), -i))].extend(dirs)
        else:
            normal.append(list(dirs))
    return [sorted(g) for g in normal if total(g)]
