"""What a documentation plan is made of: candidate pages and their checks, coverage, directories, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S

#: Names that suggest a utility, and thresholds of the checks.
UTILITY = ("util", "helper", "misc", "common", "base", "mixin", "compat", "internal", "private")
LEAST_BODY, LEAST_IDENTITY, LEAST_EVIDENCE, MOST_UTILITY, DOCS_SHARE = 50, 0.1, 0.2, 0.5, 0.7
LEAST_PAGE, MOST_PAGE = 2, 60
#: Weights of relations between directories, and of layers.
COUPLING = {
    "inheritance": 3, "implementation": 3, "composition": 3, "overrides": 3,
    "imports": 2, "calls": 2, "creates": 2, "instantiates": 2, "uses_type": 2, "references": 2,
    "aggregation": 1, "reads": 1, "writes": 1, "captures": 1, "specializes": 1,
}
LAYER_WEIGHTS = {"entry_point": 6, "public_api": 5, "core_type": 4, "infrastructure": 3, "internal": 2, "constant": 1}
#: Directories that hold nothing to document.
IGNORED_DIRECTORIES = (
    ".git", ".svn", ".hg", ".vscode", ".idea", ".vs", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".eggs",
    "egg-info", ".egg-info", "venv", ".venv", "env", ".env", "build", "dist", "target", "node_modules", "htmlcov",
    ".coverage", "coverage", ".cache", "tmp", "temp", ".DS_Store", "Thumbs.db", "logs", "log",
)
DOCUMENT_ENDINGS = (".md", ".rst", ".txt", ".adoc")


def cluster_map(nodes: DataFrame, exclude_tests: bool = True) -> DataFrame:
    """macro, micro and the nodes' columns: architectural nodes of clusters, without tests; no micro cluster counts as 0."""
    kept = nodes.where(S.is_architectural_type(F.lower("symbol_type")) & F.col("macro_cluster").isNotNull())
    if exclude_tests:
        kept = kept.where(~S.is_test_path(F.coalesce("rel_path", F.lit(""))))
    return kept.withColumn("macro", F.col("macro_cluster")).withColumn("micro", F.coalesce("micro_cluster", F.lit(0)))


def candidates(mapped: DataFrame) -> DataFrame:
    """A row per (macro, micro): size, the five measures, and the class of the page."""
    kind = F.lower("symbol_type")
    doc, identity, supporting = kind.isin(*S.LEGACY_DOCS), kind.isin(*S.IDENTITY_TYPES), kind.isin(*S.SUPPORTING_TYPES)
    name = F.coalesce("symbol_name", F.lit(""))
    counts = mapped.groupBy("macro", "micro").agg(
        F.count("*").alias("n"),
        F.count_if(identity).alias("identity"),
        F.count_if(identity | supporting).alias("code"),
        F.count_if(doc).alias("docs"),
        F.count_if(~doc & (F.length(F.coalesce("source_text", F.lit(""))) >= LEAST_BODY)).alias("bodies"),
        F.count_if(~doc & (name != "") & ~name.startswith("_")).alias("public"),
        F.count_if(F.lower(name).rlike("|".join(UTILITY))).alias("utility"),
        F.countDistinct(F.when(F.coalesce("rel_path", F.lit("")) != "", F.col("rel_path"))).alias("file_spread"),
    )
    per_code = lambda c: F.col(c) / F.greatest("code", F.lit(1))
    kind = F.when(F.col("docs") / F.col("n") >= DOCS_SHARE, "docs").when((F.col("file_spread") >= 3) & (F.col("file_spread") > F.col("n") / 2), "bridge")
    kind = kind.when((F.col("docs") == 0) & (F.col("code") > 0), "code").when((F.col("docs") > 0) & (F.col("code") > 0), "mixed").otherwise("code")
    return counts.select(
        "macro",
        "micro",
        "n",
        (F.col("identity") / F.col("n")).alias("identity_score"),
        per_code("bodies").alias("evidence"),
        (F.col("docs") / F.col("n")).alias("docs_share"),
        per_code("public").alias("public_api"),
        (F.col("utility") / F.col("n")).alias("utility_share"),
        "file_spread",
        kind.alias("classification"),
    )


def validated(pages: DataFrame) -> DataFrame:
    """Candidates with their five checks (pass, warn or fail) and the decision on their shape.

    A page may have max(60, floor(1.5 * mean size)) nodes.  The mean is one row; siblings are counted by section."""
    whole = pages.agg(F.greatest(F.lit(MOST_PAGE), F.floor(1.5 * F.avg("n"))).alias("most"))
    rows = pages.crossJoin(F.broadcast(whole)).withColumn("siblings", F.count("*").over(Window.partitionBy("macro")) - 1)
    docs = F.col("classification") == "docs"
    identity = F.when(docs | (F.col("identity_score") >= LEAST_IDENTITY), "pass").when(F.col("identity_score") > 0, "warn").otherwise("fail")
    coherence = F.when((F.col("utility_share") >= MOST_UTILITY) | (F.col("n") > F.col("most")), "warn").otherwise("pass")
    grounding = F.when(docs | (F.col("evidence") >= LEAST_EVIDENCE), "pass").otherwise("warn")
    coverage = F.when(F.col("n") < LEAST_PAGE, "fail").otherwise("pass")
    shape = F.when(F.col("classification") == "bridge", "warn").otherwise("pass")
    rows = rows.select(*pages.columns, "siblings", *(c.alias(n) for c, n in ((identity, "identity"), (coherence, "coherence"), (grounding, "grounding"), (coverage, "coverage"), (shape, "shape"))))
    split = (F.col("coherence") == "warn") | (F.col("shape") == "warn")
    merge = ((F.col("identity") == "warn") | (F.col("grounding") == "warn")) & (F.col("siblings") > 0)
    decision = F.when(F.col("identity") == "fail", "demote").when(F.col("coverage") == "fail", "merge_with").when(docs, "promote_docs")
    return rows.withColumn("decision", decision.when(split, "split_by").when(merge, "merge_with").otherwise("keep"))


def settled(checked: DataFrame) -> DataFrame:
    """macro, micro and ``into``: the page that each page ends in; null for those that are dropped.

    Pages to be merged go to the largest page of their section that stays (the smallest number of equals); with none, they stay."""
    stays = checked.where("decision NOT IN ('demote', 'merge_with')")
    largest = stays.groupBy("macro").agg(F.max_by("micro", F.struct("n", -F.col("micro"))).alias("largest"))
    own = checked.join(largest, "macro", "left")
    into = F.when(F.col("decision") == "demote", None).when(F.col("decision") == "merge_with", F.coalesce("largest", "micro")).otherwise(F.col("micro"))
    return own.select("macro", "micro", "decision", into.alias("into"))


def directory_of(path: Column) -> Column:
    return F.when(S.directory(path) == "", ".").otherwise(S.directory(path))


def coverage_report(nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: symbols, documented directories and directories in all and covered by ``covered(node_id)``."""
    own = nodes.where(S.is_architectural_type(F.lower("symbol_type"))).select("node_id", F.when(F.coalesce("rel_path", F.lit("")) != "", directory_of(F.col("rel_path"))).alias("dir"), S.is_doc_type(F.lower("symbol_type")).alias("doc"))
    own = own.join(covered.select("node_id").distinct().withColumn("_in", F.lit(True)), "node_id", "left").withColumn("held", F.col("_in").isNotNull())
    count = lambda c: F.countDistinct(F.when(c, F.col("dir")))
    return own.agg(
        F.count("*").alias("total_symbols"),
        F.count_if("held").alias("covered_symbols"),
        count(F.col("doc")).alias("doc_domains"),
        count(F.col("doc") & F.col("held")).alias("covered_doc_domains"),
        F.countDistinct("dir").alias("directories"),
        count(F.col("held")).alias("covered_directories"),
    )


def uncovered_symbols(nodes: DataFrame, covered: DataFrame, most: int = 20, least: int = 7) -> DataFrame:
    """The ``most`` uncovered symbols of highest priority (``least`` or more)."""
    own = nodes.where(S.is_architectural_type(F.lower("symbol_type"))).join(covered.select("node_id"), "node_id", "left_anti")
    own = own.select("node_id", "symbol_name", "symbol_type", S.type_priority(F.col("symbol_type")).cast("int").alias("priority")).where(F.col("priority") >= least)
    return own.orderBy(F.desc("priority"), "node_id").limit(most)


def dominant_symbols(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Per section the ``most`` symbols of highest min(out-edges, 10) + 2 for a docstring."""
    out = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("out"))
    rows = nodes.where(S.is_architectural_type(F.lower("symbol_type")) & F.col("macro_cluster").isNotNull()).join(out, "node_id", "left")
    score = F.least(F.coalesce("out", F.lit(0)), F.lit(10)) + F.when(F.coalesce("docstring", F.lit("")) != "", 2).otherwise(0)
    rows = rows.select(F.col("macro_cluster").alias("macro"), "node_id", score.cast("int").alias("score"))
    place = F.row_number().over(Window.partitionBy("macro").orderBy(F.desc("score"), "node_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


def directory_symbols(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """node_id, name, type, dir, layer and connections of the code symbols of directories that count."""
    kind = F.lower("symbol_type")
    own = nodes.where(kind.isin(*S.CODE_TYPES) & (F.coalesce("symbol_name", F.lit("")) != "") & (F.coalesce("rel_path", F.lit("")) != ""))
    own = own.where(~F.arrays_overlap(F.split(S.directory(F.col("rel_path")), "/"), F.array(*map(F.lit, IGNORED_DIRECTORIES))))
    named = own.select("node_id", F.col("symbol_name").alias("name"), kind.alias("type"), directory_of(F.col("rel_path")).alias("dir"), "rel_path", S.layer(F.col("symbol_name"), kind, F.col("rel_path"), F.col("parent_symbol")).alias("layer"))
    return named.join(degree.select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("connections")), "node_id")


def directory_coupling(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """a, b, weight: the summed coupling of relations between two directories that hold code symbols."""
    dirs = nodes.where(F.coalesce("rel_path", F.lit("")) != "").select("node_id", directory_of(F.col("rel_path")).alias("dir")).join(symbols.select("dir").distinct(), "dir", "left_semi")
    side = lambda x, of: dirs.select(F.col("node_id").alias(of), F.col("dir").alias(x))
    weighed = edges.select("source_id", "target_id", S.looked_up(F.lower("rel_type"), COUPLING, 0).alias("w")).where("w > 0")
    both = weighed.join(side("da", "source_id"), "source_id").join(side("db", "target_id"), "target_id").where("da <> db")
    return both.groupBy(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).agg(F.sum("w").alias("weight"))


def doc_clusters(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """group, files, endings, dirs: directories with documents but no code symbols, deep ones by their first two segments."""
    parts = F.split("rel_path", "/")
    ending = F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1))
    docs = paths.where(~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRECTORIES)))).select("rel_path", ending.alias("ending"), directory_of(F.col("rel_path")).alias("dir")).where(F.col("ending").isin(*DOCUMENT_ENDINGS))
    docs = docs.join(symbols.select("dir").distinct(), "dir", "left_anti")
    pieces = F.split("dir", "/")
    group = F.when(F.size(pieces) <= 2, F.col("dir")).otherwise(F.array_join(F.slice(pieces, 1, 2), "/"))
    return docs.groupBy(group.alias("group")).agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("ending")), ",").alias("endings"), F.countDistinct("dir").alias("dirs"))


def prioritized(symbols: DataFrame, page: str = "dir", most: int = 30) -> DataFrame:
    """Per page the symbols by layer weight * 200 + min(connections, 100); pages of more than ``most`` keep so many, each name once."""
    score = S.looked_up(F.col("layer"), LAYER_WEIGHTS, 2) * 200 + F.least("connections", F.lit(100))
    by = Window.partitionBy(page).orderBy(F.desc("score"), "node_id")
    rows = symbols.select(page, "node_id", "name", score.cast("int").alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy(page))).where((F.col("rank") <= most) | (F.col("n") <= most))
    again = F.row_number().over(Window.partitionBy(page, "name").orderBy("rank"))
    return rows.withColumn("_k", again).where((F.col("_k") == 1) | (F.col("n") <= most)).select(page, "node_id", "name", "score", "rank")


def sibling_groups(symbols: DataFrame, least: int = 10) -> DataFrame:
    """dir, parent, group: directories under one parent, in order, cut whenever 2 * least symbols are together.

    The running sum starts anew at each cut, so it is a fold over the parent's directories (one row of small pairs)."""
    count = symbols.groupBy("dir").agg(F.count("*").alias("n"))
    parent = F.when(F.col("dir").contains("/"), S.directory(F.col("dir"))).otherwise("<root>")
    rows = count.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("dir", "n"))).alias("dirs"))
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<dir:string,group:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["held"] + x["n"] >= 2 * least
        placed = F.concat(acc["out"], F.array(F.struct(x["dir"].alias("dir"), acc["group"].alias("group"))))
        return F.struct(F.when(full, acc["group"] + 1).otherwise(acc["group"]).alias("group"), F.when(full, F.lit(0).cast("long")).otherwise(acc["held"] + x["n"]).alias("held"), placed.alias("out"))

    return rows.select("parent", F.explode(F.aggregate("dirs", start, step)["out"]).alias("o")).select("parent", "o.dir", "o.group")
