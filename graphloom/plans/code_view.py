"""A code-like graph over the parquet tables: symbols with types, files, texts and clusters, and classed edges.

The expressions are valid in Spark SQL and in the oracle's dialect alike, so both sides read one and the same view.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.session import table


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


_CAMEL = f"upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || {_s('p_partkey % 40')}"
_SNAKE = f"replace(p_name, ' ', '_') || {_s('p_partkey % 40')}"
_TEST = "p_partkey % 11 = 0"
_EXT = "CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.cpp' WHEN 3 THEN '.go' WHEN 4 THEN '.rs' ELSE '.ts' END"

_PARTS = {
    "node_id": f"'p:' || {_s('p_partkey')}",
    "symbol_name": f"CASE WHEN p_partkey % 110 = 0 THEN 'Test' || {_CAMEL} WHEN p_partkey % 70 = 1 THEN 'run_' || {_SNAKE} WHEN p_partkey % 10 = 1 THEN {_SNAKE} WHEN p_partkey % 10 = 6 THEN upper({_SNAKE}) ELSE {_CAMEL} END",
    "symbol_type": "CASE p_partkey % 10 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' WHEN 4 THEN 'struct' WHEN 5 THEN 'enum' WHEN 6 THEN 'constant' WHEN 7 THEN 'type_alias' WHEN 8 THEN 'macro' ELSE 'trait' END",
    "rel_path": f"CASE WHEN {_TEST} THEN 'tests/' ELSE 'src/' END || lower(p_type) || '/' || CASE p_partkey % 13 WHEN 0 THEN 'utils' WHEN 1 THEN 'internal' ELSE 'b' || split_part(p_brand, '#', 2) END || '/' || CASE WHEN {_TEST} THEN 'test_' ELSE '' END || split_part(p_name, ' ', 2) || {_EXT}",
    "file_name": f"CASE WHEN {_TEST} THEN 'test_' ELSE '' END || split_part(p_name, ' ', 2)",
    "language": "CASE p_size % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'cpp' WHEN 3 THEN 'go' WHEN 4 THEN 'rust' ELSE 'typescript' END",
    "parent_symbol": f"CASE WHEN p_partkey % 10 = 2 THEN 'p:' || {_s('p_partkey - 2')} ELSE NULL END",
    "start_line": "CAST(1 + p_partkey % 300 AS INT)",
    "end_line": "CAST(1 + p_partkey % 300 + p_size AS INT)",
    "source_text": "'def ' || replace(p_name, ' ', '_') || ' in ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' with a body that is long enough to count as code' ELSE '' END",
    "docstring": "CASE WHEN p_partkey % 3 = 0 THEN 'Handles every ' || p_name || ' of the ' || lower(p_type) || ' kind.' ELSE '' END",
    "macro_cluster": "CAST(p_size % 8 AS INT)",
    "micro_cluster": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END",
}
_SUPPLIERS = {
    "node_id": f"'s:' || {_s('s_suppkey')}",
    "symbol_name": f"'mod' || {_s('s_suppkey')}",
    "symbol_type": "'module'",
    "rel_path": f"CASE WHEN s_suppkey % 2 = 0 THEN 'src/mods/mod_' ELSE 'tests/mods/test_mod_' END || {_s('CAST(floor(s_suppkey / 2) AS BIGINT)')} || '.py'",
    "file_name": f"CASE WHEN s_suppkey % 2 = 0 THEN 'mod_' ELSE 'test_mod_' END || {_s('CAST(floor(s_suppkey / 2) AS BIGINT)')}",
    "language": "'python'",
    "parent_symbol": "CAST(NULL AS STRING)",
    "start_line": "CAST(0 AS INT)",
    "end_line": "CAST(100 AS INT)",
    "source_text": "'module of ' || s_name",
    "docstring": "''",
    "macro_cluster": "CAST(s_suppkey % 8 AS INT)",
    "micro_cluster": "CAST(s_suppkey % 5 AS INT)",
}
_DOCS = {
    "node_id": f"'d:' || {_s('doc_id')}",
    "symbol_name": f"'note' || {_s('doc_id')}",
    "symbol_type": "CASE doc_id % 4 WHEN 0 THEN 'markdown_document' WHEN 1 THEN 'text_chunk' WHEN 2 THEN 'module_doc' ELSE 'file_doc' END",
    "rel_path": f"'docs/' || CASE doc_id % 5 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' WHEN 2 THEN 'large' WHEN 3 THEN 'medium' ELSE 'promo' END || '/b' || {_s('doc_id % 25')} || '/' || {_s('doc_id')} || '.md'",
    "file_name": _s("doc_id"),
    "language": "'markdown'",
    "parent_symbol": "CAST(NULL AS STRING)",
    "start_line": "CAST(0 AS INT)",
    "end_line": "CAST(0 AS INT)",
    "source_text": f"'See [the module](../../../src/mods/mod_' || {_s('doc_id % 50')} || '.py#top), [a page](https://example.com/x) and `RedWidget' || {_s('(doc_id % 4) * 10')} || '` or `pkg.BlueBolt' || {_s('doc_id % 40')} || '`.' || chr(10) || coalesce(text, '')",
    "docstring": "''",
    "macro_cluster": "CAST(doc_id % 9 AS INT)",
    "micro_cluster": "CAST(doc_id % 5 AS INT)",
}
_EDGES = {
    "source_id": f"'p:' || {_s('l_partkey')}",
    "target_id": f"'p:' || {_s('CAST(floor(l_orderkey / 10) AS BIGINT)')}",
    "rel_type": "CASE l_linenumber WHEN 1 THEN 'calls' WHEN 2 THEN 'references' WHEN 3 THEN 'creates' WHEN 4 THEN 'inheritance' WHEN 5 THEN 'composition' WHEN 6 THEN 'defines' ELSE 'alias_of' END",
    "edge_class": "CASE l_suppkey % 9 WHEN 0 THEN 'lexical' WHEN 1 THEN 'directory' WHEN 2 THEN 'doc' ELSE 'structural' END",
}
_FROM = (("part", _PARTS), ("supplier", _SUPPLIERS), ("documents", _DOCS))


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf, name).selectExpr(*(f"{e} AS {c}" for c, e in columns.items())) for name, columns in _FROM])


def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A bag: parallel edges stay."""
    return table(spark, sf, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in _EDGES.items()))


CODE_SQL = "cn AS (" + " UNION ALL ".join(f"SELECT {_list(columns)} FROM {name}" for name, columns in _FROM) + f"), ce AS (SELECT {_list(_EDGES)} FROM lineitem)"
