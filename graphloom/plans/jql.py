"""JQL: ``field:value`` clauses compiled to one DataFrame plan; and questions in words turned into JQL.

Clauses are a conjunction; ``OR`` between clauses separates alternatives (``strict=True`` reads it as AND); ``!=``
negates.  Fields: type, layer, file, name, text, related, dir, has_rel, connections, limit.  Unknown fields and stray
words are ignored.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import graph as G

_CLAUSE = re.compile(r'([a-z_]+):(?:(!=?|>=|<=|>|<|=)?\s*)("[^"]*"|[^\s"]+)|(\bAND\b)|(\bOR\b)')
_FIELDS = {"type", "layer", "file", "name", "text", "related", "dir", "has_rel", "connections", "limit"}
_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "": operator.eq, "!": operator.ne, "!=": operator.ne}
#: Names that stand for a relation, either way round.
RELATION_NAMES = {"inherits": "inheritance", "extends": "inheritance", "implements": "implementation", "contain": "contains", "uses": "references", "refers": "references", "call": "calls", "invokes": "calls", "composes": "composition", "has": "composition"}
RELATED_HOPS = 3


@dataclass
class Clause:
    field: str
    op: str
    value: str


@dataclass
class Jql:
    alternatives: list[list[Clause]] = field(default_factory=lambda: [[]])
    limit: int = 20
    direction: str = "both"


def is_jql(text: str) -> bool:
    return any(m[1] in _FIELDS for m in _CLAUSE.finditer(text) if m[1])


def parse(text: str, strict: bool = False) -> Jql:
    out = Jql()
    for m in _CLAUSE.finditer(text):
        if m[5] and not strict and out.alternatives[-1]:
            out.alternatives.append([])
        elif m[1] in _FIELDS:
            value = m[3].strip('"')
            if m[1] == "limit":
                out.limit = max(1, min(500, int(value))) if value.isdigit() else out.limit
            elif m[1] == "dir":
                out.direction = value if value in ("in", "out", "both") else "both"
            else:
                out.alternatives[-1].append(Clause(m[1], m[2] or "", value))
    out.alternatives = [a for a in out.alternatives if a]
    return out


def glob(value: str) -> str:
    """fnmatch as an anchored regular expression: * crosses slashes."""
    out, i = "", 0
    while i < len(value):
        c = value[i]
        if c == "[" and (j := value.find("]", i + 2)) > 0:
            body = value[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?is)^{out}$"


def matches(column: Column, value: str) -> Column:
    return column.rlike(glob(value)) if re.search(r"[*?\[]", value) else F.lower(column) == value.lower()


def compared(number: Column, c: Clause) -> Column:
    """A clause that compares a number; what is no number matches nothing."""
    return _COMPARE[c.op](number, int(c.value)) if c.value.isdigit() else F.lit(False)


def _holds(nodes: DataFrame, value: str) -> Column:
    """All words of a value, in the name, docstring or text of a node."""
    where = F.concat_ws(" ", *(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("symbol_name", "docstring", "source_text") if c in nodes.columns))
    out = F.lit(True)
    for word in value.lower().split():
        out = out & where.contains(word)
    return out


def compile_jql(query: str | Jql, nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """node_id, symbol_name, symbol_type, rel_path and connections of the nodes that match, the best connected first."""
    q = parse(query, strict) if isinstance(query, str) else query
    d = G.degrees(nodes, edges).select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("connections"))
    rows = nodes.join(d, "node_id")
    parts = None
    for clauses in q.alternatives:
        own = rows
        for c in clauses:
            negate = c.op in ("!", "!=")
            if c.field == "connections":
                own = own.where(compared(F.col("connections"), c))
                continue
            if c.field == "has_rel":
                own = own.join(ends(edges, RELATION_NAMES.get(c.value.lower(), c.value.lower()), q.direction), "node_id", "left_anti" if negate else "left_semi")
                continue
            if c.field == "related":
                anchors = nodes.where(matches(F.col("symbol_name"), c.value)).select("node_id")
                reached = G.within_hops(edges, anchors, RELATED_HOPS, q.direction).where("hop > 0").select("node_id")
                own = own.join(reached, "node_id", "left_anti" if negate else "left_semi")
                continue
            test = {
                "type": lambda v: matches(F.col("symbol_type"), v),
                "layer": lambda v: matches(S.layer(F.col("symbol_name"), F.col("symbol_type"), F.col("rel_path"), F.col("parent_symbol") if "parent_symbol" in nodes.columns else F.lit(None).cast("string")), v),
                "file": lambda v: F.col("rel_path").rlike(glob(v)) if re.search(r"[*?\[]", v) else S.within(F.col("rel_path"), v),
                "name": lambda v: matches(F.col("symbol_name"), v),
                "text": lambda v: _holds(nodes, v),
            }[c.field](c.value)
            own = own.where(~test if negate else test)
        parts = own if parts is None else parts.union(own)
    if parts is None:
        parts = rows
    elif len(q.alternatives) > 1:
        parts = parts.dropDuplicates(["node_id"])
    return parts.select("node_id", "symbol_name", "symbol_type", "rel_path", "connections").orderBy(F.desc("connections"), "node_id").limit(q.limit)


def ends(edges: DataFrame, relation: str, direction: str) -> DataFrame:
    own = edges.where(F.col("rel_type") == relation)
    out = own.select(F.col("source_id").alias("node_id"))
    into = own.select(F.col("target_id").alias("node_id"))
    return {"out": out, "in": into, "both": out.union(into)}[direction]


_TYPE_WORDS = {"customers": "customer", "suppliers": "supplier", "parts": "part", "nations": "nation", "regions": "region", "orders": "orders", "classes": "class", "functions": "function", "interfaces": "interface"}


def from_question(question: str) -> str:
    """A question in words as JQL: type words, ``in <path>``, ``related to <name>``, then the rest as text."""
    out, rest = [], question
    for pattern, clause in ((r"\b(?:in|under)\s+([\w./-]*/[\w./-]*)", "file"), (r"\b(?:related to|connected to|near)\s+\"?([\w:#-]+)\"?", "related"), (r"\b(?:that|which)\s+(inherits|extends|implements|calls|uses|contains)\b", "has_rel")):
        if m := re.search(pattern, rest, re.I):
            out.append(f"{clause}:{m[1]}")
            rest = rest[: m.start()] + rest[m.end() :]
    from graphloom.operators.search import keywords

    words = keywords(rest)
    types = [_TYPE_WORDS.get(w, w if w in _TYPE_WORDS.values() else None) for w in words]
    out = [f"type:{t}" for t in dict.fromkeys(filter(None, types))] + out
    text = [w for w, t in zip(words, types, strict=True) if not t and w not in ("find", "show", "list", "all", "get")]
    return " ".join(out + ([f'text:"{" ".join(text)}"'] if text else []))
