"""Source files as tables: discovery by path rules, Python symbols and relations by ``ast``, Markdown sections, snapshots."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages of file endings.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "go": "go",
    "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "h": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "c": "c",
    "rb": "ruby", "php": "php", "rs": "rust", "kt": "kotlin", "scala": "scala", "swift": "swift", "dart": "dart", "r": "r", "m": "objective_c",
    "sh": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell", "psm1": "powershell", "bat": "batch", "cmd": "batch",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "sql": "sql",
    "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "wsdl": "xml", "xsd": "xml", "toml": "toml", "cfg": "config", "conf": "config",
    "dockerfile": "dockerfile", "gradle": "groovy", "kts": "kotlin_script", "proto": "protobuf", "tf": "terraform", "tfvars": "terraform", "hcl": "hcl", "mod": "gomod",
    "md": "markdown", "rst": "restructured_text", "txt": "text",
}
#: Kinds of files that go by their names.
NAMES = {
    "Makefile": "build_config", "makefile": "build_config", "GNUmakefile": "build_config", "CMakeLists.txt": "build_config", "Justfile": "build_config",
    "Rakefile": "build_config", "BUILD": "build_config", "WORKSPACE": "build_config",
    "Dockerfile": "infrastructure", "Containerfile": "infrastructure", "Vagrantfile": "infrastructure", "Procfile": "infrastructure",
    "Gemfile": "config", "Pipfile": "config", "CODEOWNERS": "config", ".editorconfig": "config", ".gitignore": "config", ".env": "config",
    "Jenkinsfile": "script", "LICENSE": "plaintext", "CHANGELOG": "plaintext", "CONTRIBUTING": "plaintext", "AUTHORS": "plaintext",
}
EXCLUDED = r"(^|/)(\.git|\.svn|\.hg|node_modules|__pycache__|\.pytest_cache|\.mypy_cache|\.tox|\.eggs|\.idea|\.vscode|\.vs|\.venv|venv|dist|build|target|vendor|\.coverage|\.cache)/|\.(class|jar|war)$"


def language(path: Column) -> Column:
    """By the file's name, or else by its ending."""
    known = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    named = F.element_at(known(NAMES), F.regexp_extract(path, "([^/]*)$", 1))
    return F.coalesce(named, F.element_at(known(LANGUAGES), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("unknown"))


def files(spark: SparkSession, root: str, max_bytes: int = 10 << 20, allowed: tuple[str, ...] = ()) -> DataFrame:
    """rel_path, language, content and skipped of the files below a folder but excluded ones, of the ``allowed`` endings if given.

    Files larger than ``max_bytes`` are listed with ``skipped`` true and without content, which is not read (the length is pushed
    down); contents of excluded files are read by their tasks and dropped there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", f"^.*?{root.split(':')[-1].rstrip('/')}/", "")
    small = found.where(F.col("length") <= max_bytes).select(rel.alias("rel_path"), F.col("content").cast("string").alias("content"), F.lit(False).alias("skipped"))
    large = found.where(F.col("length") > max_bytes).select(rel.alias("rel_path"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("skipped"))
    rows = small.unionByName(large).where(~F.col("rel_path").rlike(EXCLUDED))
    if allowed:
        rows = rows.where(F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1)).isin(*allowed))
    return rows.withColumn("language", language(F.col("rel_path")))


def _symbols(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    stem = path.rsplit("/", 1)[-1].removesuffix(".py")

    def walk(node: ast.AST, parent: str, inside: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside == "class" else "function"
                own = f"{parent}.{child.name}" if parent else child.name
                yield ("symbol", f"python::{stem}::{own}", child.name, kind, child.lineno, child.end_lineno, ast.get_docstring(child) or "", None)
                if parent:
                    yield ("edge", f"python::{stem}::{parent}", own, "defines", child.lineno, None, None, f"python::{stem}::{own}")
                for base in getattr(child, "bases", []):
                    yield ("edge", f"python::{stem}::{own}", ast.unparse(base), "inheritance", child.lineno, None, None, None)
                yield from walk(child, own, kind)
            else:
                if isinstance(child, ast.Call) and parent:
                    name = ast.unparse(child.func).rsplit(".", 1)[-1]
                    yield ("edge", f"python::{stem}::{parent}", name, "creates" if name[:1].isupper() else "calls", child.lineno, None, None, None)
                elif isinstance(child, (ast.Import, ast.ImportFrom)):
                    for a in child.names:
                        yield ("edge", f"python::{stem}", a.name, "imports", child.lineno, None, None, None)
                yield from walk(child, parent, inside)

    yield from walk(tree, "", None)


def parsed(source: DataFrame) -> DataFrame:
    """Symbols and relations of Python files, a row each; a file that does not parse gives none."""
    fields = "item string, id string, name string, kind string, start_line int, end_line int, docstring string, target string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in fields.split(", ")]
        for frame in frames:
            rows = [(p, *s) for p, t in zip(frame.rel_path, frame.content, strict=True) for s in _symbols(p, t or "")]
            yield pd.DataFrame(rows, columns=["rel_path", *names]).astype({"start_line": "Int32", "end_line": "Int32"})

    return source.where("language = 'python'").select("rel_path", "content").mapInPandas(run, f"rel_path string, {fields}")


def resolved(items: DataFrame) -> DataFrame:
    """Edges with targets found by name: the same file first, then any file; others are dropped as external."""
    symbols = items.where("item = 'symbol'").select(F.col("id").alias("sid"), F.col("name").alias("sname"), F.col("rel_path").alias("spath"))
    edges = items.where("item = 'edge'")
    known = edges.where("target IS NOT NULL").select(F.col("id").alias("source_id"), F.col("target").alias("target_id"), F.col("kind").alias("rel_type"))
    by_name = edges.where("target IS NULL").join(symbols, F.col("name") == F.col("sname")).groupBy("id", "kind", "name", "rel_path", "start_line").agg(F.min_by("sid", F.struct(F.col("spath") != F.col("rel_path"), "sid")).alias("target_id"))
    return known.unionByName(by_name.select(F.col("id").alias("source_id"), "target_id", F.col("kind").alias("rel_type")))


def sections(docs: DataFrame) -> DataFrame:
    """Markdown files cut at headings: rel_path, section number, title and body."""
    parts = F.split("content", r"(?m)^(?=#{1,6}\s)")
    rows = docs.where("language = 'markdown'").select("rel_path", F.posexplode(parts).alias("section", "body")).where(F.trim("body") != "")
    return rows.select("rel_path", "section", F.regexp_extract("body", r"^#{1,6}\s+([^\n]*)", 1).alias("title"), "body")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot: both tables replaced; stale nodes and repeated edges cannot stay."""
    nodes.dropDuplicates(["node_id"]).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
