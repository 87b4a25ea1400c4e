"""Scores of documents for a page, their tokens, chunks and shorter forms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.graph import within_hops

#: Weights of relations to a page's topic, and scores of types.
RELATION_WEIGHTS = {
    "defines": 15, "contains": 15, "has_member": 15,
    "calls": 12, "invokes": 12, "instantiates": 12, "creates": 12,
    "inheritance": 10, "extends": 10, "implements": 10, "implementation": 10,
    "uses": 8, "composition": 8, "aggregation": 8, "references": 8,
}
TYPE_SCORES = {
    "class": 10, "interface": 10, "struct": 10, "trait": 10, "protocol": 10,
    "readme": 10, "documentation": 9, "markdown": 8, "text_chunk": 8, "config": 8,
    "impl": 9, "enum": 8,
    "type_alias": 7, "function": 7, "constant": 7,
    "method": 6, "namespace": 5, "module": 5, "variable": 3, "macro": 3,
}
WHOLE_DOCUMENT, CHUNK_LINES = 17_000, 30


def document_scores(docs: DataFrame, edges: DataFrame, topic: str, folders: tuple[str, ...] = (), depth: int = 10) -> DataFrame:
    """node_id and score for a page about the node ``topic``: 20 in a wanted folder, the weights of edges with the topic, the type's
    score, 8 in its file or 5 in its directory, -0.5 for each directed hop from it (-5 beyond ``depth`` hops or out of reach), -1 from
    5,000 and -2 from 10,000 characters."""
    spark = docs.sparkSession
    weights = S.looked_up(F.col("rel_type"), RELATION_WEIGHTS, 0)
    ties = edges.where((F.col("source_id") == topic) | (F.col("target_id") == topic)).select(F.when(F.col("source_id") == topic, F.col("target_id")).otherwise(F.col("source_id")).alias("node_id"), weights.alias("w"))
    ties = ties.groupBy("node_id").agg(F.sum("w").alias("relation"))
    start = spark.createDataFrame([(topic,)], "node_id string")
    hops = within_hops(edges, start, depth, "out").withColumnRenamed("hop", "hops")
    own = docs.where(F.col("node_id") == topic).select(F.col("rel_path").alias("_path")).limit(1)
    path = F.coalesce("rel_path", F.lit(""))
    inside = F.lit(False)
    for folder in folders:
        inside = inside | path.contains(folder)
    length = F.length(F.coalesce("source_text", F.lit("")))
    rows = docs.join(ties, "node_id", "left").join(hops, "node_id", "left").crossJoin(F.broadcast(own))
    near = F.when(F.col("_path") == path, 8).when(S.directory(F.col("_path")) == S.directory(path), 5).otherwise(0)
    far = F.when(F.col("hops").isNull(), -5.0).otherwise(-0.5 * F.col("hops"))
    size = F.when(length < 5000, 0).when(length < 10_000, -1).otherwise(-2)
    score = F.when(inside, 20).otherwise(0) + F.coalesce("relation", F.lit(0)) + S.looked_up(F.lower("symbol_type"), TYPE_SCORES, 1) + near + far + size
    return rows.select("node_id", score.cast("double").alias("score"))


def fallback_tokens(text: Column, per: int = 4) -> Column:
    """Characters by ``per``: the count where no tokenizer is at hand."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / per).cast("long")


def document_tokens(text: Column, *metadata: Column) -> Column:
    """Tokens of a text, of its metadata (joined by spaces), and 20 for the frame if there is any."""
    given = F.concat_ws(" ", *(F.when(m != "", m) for m in metadata))
    return fallback_tokens(text) + F.when(given != "", fallback_tokens(given) + 20).otherwise(0)


def line_chunks(docs: DataFrame, key: str, text: str = "text", lines: int = CHUNK_LINES) -> DataFrame:
    """key, chunk, content, summary, start_line, end_line: texts of up to WHOLE_DOCUMENT characters whole, longer ones by ``lines``
    lines; blank chunks are left out, and the summary is the first fifty characters of the first line that is not blank."""
    body = F.coalesce(text, F.lit(""))
    whole = F.length(body) <= WHOLE_DOCUMENT
    parts = F.split(body, "\n")
    rows = docs.select(key, F.when(whole, F.array(F.struct(F.lit(0).alias("i"), parts.alias("own")))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / lines).cast("int")), lambda i: F.struct(i.alias("i"), F.slice(parts, i * lines + 1, F.lit(lines)).alias("own")))).alias("cs"), whole.alias("whole"))
    rows = rows.select(key, "whole", F.explode("cs").alias("c")).select(key, "whole", F.col("c.i").alias("i"), "c.own")
    content = F.array_join("own", "\n")
    first = F.coalesce(F.get(F.filter(F.transform("own", lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    summary = F.when(F.length(first) > 50, F.concat(F.substr(first, F.lit(1), F.lit(50)), F.lit("..."))).otherwise(first)
    rows = rows.select(key, F.col("i").alias("chunk"), content.alias("content"), summary.alias("summary"), (F.col("i") * lines + 1).alias("start_line"), (F.col("i") * lines + F.size("own")).alias("end_line"), "whole")
    return rows.where(F.col("whole") | (F.trim(F.regexp_replace("content", r"\s+", " ")) != "")).drop("whole")


#: How a declaration begins, by language; bodies are left out.
_DECLARATION = {
    "python": re.compile(r"^\s*(?:@\w|class\s|(?:async\s+)?def\s)"),
    "java": re.compile(r"^\s*(?:@\w+|(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)*(?:class|interface|enum|record)\s|(?:(?:public|protected)\s+)[\w<>\[\], .?]+\()"),
    "typescript": re.compile(r"^\s*(?:@\w+|(?:export\s+)?(?:abstract\s+)?(?:class|interface|enum|type|function)\s|(?:(?:public|protected|static|async|readonly|get|set)\s+)*\w+\s*\([^)]*\)\s*[:{])"),
    "go": re.compile(r"^\s*(?:func\s|type\s|package\s)"),
    "rust": re.compile(r"^\s*(?:#\[|(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|type|mod)\b)"),
    "cpp": re.compile(r"^\s*(?:template\b|class\s|struct\s|enum\s|namespace\s|(?:public|protected):|[\w:<>*&~ ]+\([^;{}]*\)\s*(?:const)?\s*(?:override)?\s*[;{])"),
}
_DECLARATION["javascript"] = _DECLARATION["typescript"]
_DECLARATION["c"] = _DECLARATION["cpp"]
_DECLARATION["csharp"] = _DECLARATION["c_sharp"] = _DECLARATION["java"]
_METHOD_NAME = re.compile(r"(?:\bdef|\bfn|\bfunc(?:\s*\([^)]*\))?|[\w>\]]\s+\*?)\s*(\w+)\s*\(")


def _signatures(content: str, language: str) -> str:
    begins = _DECLARATION.get(language, _DECLARATION["python"])
    return "\n".join(x.rstrip().rstrip("{").rstrip() for x in content.split("\n") if begins.match(x))


def shortened(content: str, kind: str, language: str, tier: int, name: str = "", path: str = "", parent: str = "") -> str:
    """A text for a tier: 1 whole; 2 its signatures (whole constants, interfaces and enums, the head of other kinds); 3 a summary."""
    if tier <= 1:
        return content
    if tier == 2:
        if kind in ("constant", "interface", "enum"):
            return content
        if kind in ("class", "struct", "trait", "impl", "protocol", "module", "file", "namespace"):
            return _signatures(content, language) or content[:500]
        if kind in ("function", "method"):
            return next((x for x in _signatures(content, language).split("\n") if x), content.split("\n", 1)[0])
        most = 800 if kind in ("type_alias", "macro") else 500
        return content[:most] + "\n..." if len(content) > most else content
    out = [f"# {kind.title()}: {name}", f"File: {path}", f"Language: {language}", *([f"Parent: {parent}"] if parent else [])]
    if kind in ("class", "interface"):
        methods = list(dict.fromkeys(m[1] for x in _signatures(content, language).split("\n") if (m := _METHOD_NAME.search(x))))
        shown = methods[:10] if kind == "class" else methods
        out += [f"Methods: {', '.join(shown)}"] if shown else []
        out += [f"... and {len(methods) - 10} more"] if kind == "class" and len(methods) > 10 else []
    elif kind in ("function", "method"):
        out += [f"Signature: {x}"] if (x := shortened(content, kind, language, 2)) else []
    elif kind == "enum":
        values = re.findall(r"^\s*(\w+)\s*(?:=|,|$)", content.split("{", 1)[-1].split(":", 1)[-1], re.M)[:10]
        out += [f"Values: {', '.join(values)}"] if values else []
    return "\n".join(out)


def compressed(docs: DataFrame, tier: str = "tier") -> DataFrame:
    """node_id, tier, content: the texts of ``docs(node_id, symbol_name, symbol_type, language, rel_path, parent_symbol, source_text)``
    for their tiers; documentation stays whole below tier 3."""
    given = docs.select("node_id", F.col(tier).cast("int").alias("tier"), F.coalesce("source_text", F.lit("")).alias("text"), F.when(S.is_doc_type(F.lower("symbol_type")), F.lit("constant")).otherwise(F.lower("symbol_type")).alias("kind"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in (("language", "language"), ("symbol_name", "name"), ("rel_path", "path"), ("parent_symbol", "parent"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "kind", "language", "tier", "name", "path", "parent")), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("tier"), pa.array([shortened(*r) for r in rows], pa.string())], ["node_id", "tier", "content"])

    return given.mapInArrow(run, f"node_id {dict(docs.dtypes)['node_id']}, tier int, content string")
