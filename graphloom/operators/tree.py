"""Folders of a repository: what each holds itself and with all below it, nearest to the root first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of code files and of files that are read as documents.
CODE_ENDINGS = tuple("py js ts jsx tsx java go rs rb cpp cc cxx c++ c h hpp hh hxx cs swift kt kts scala php vue svelte lua r jl ex exs erl hs clj cljs ml fs fsx dart groovy gradle".split())
DOC_ENDINGS = tuple("md rst txt adoc doc docx pdf html htm xml json yaml yml toml ini cfg conf properties env gradle kts wsdl xsd proto tf tfvars hcl mod sh bash bat cmd ps1 psm1".split())
#: Folders that are not looked into, by name; hidden ones but these few, and those that begin with an underscore.
IGNORED = ("egg-info", "venv", "env", "build", "dist", "target", "node_modules", "htmlcov", "coverage", "tmp", "temp", "logs", "log")
SHOWN_DOTS = (".github", ".gitlab", ".circleci", ".husky")
MOST_DEPTH, MOST_FOLDERS = 5, 1_000


def _ignored(name: str) -> str:
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    return f"({name} IN ({listed(IGNORED)}) OR (startswith({name}, '.') AND {name} NOT IN ({listed(SHOWN_DOTS)})) OR startswith({name}, '_') OR endswith({name}, '.egg-info'))"


def folder_tree(files: DataFrame, depth: int = MOST_DEPTH, most: int | None = MOST_FOLDERS) -> DataFrame:
    """path, name, depth, files, code_files, doc_files, subdirs (its own) and all_files, all_code, all_docs (with all below) of the
    folders of ``files(rel_path)``, without those below an ignored one, down to ``depth``; the first ``most`` by depth, then path.

    Every file adds one to each folder above it; sums combine before the shuffle, so the root costs no more than a leaf.
    """
    parts = F.filter(F.split(F.regexp_replace("rel_path", r"^(\./)+", ""), "/"), lambda p: p != "")
    rows = files.where(F.col("rel_path").isNotNull()).select(parts.alias("parts")).where("size(parts) > 0").select(F.element_at("parts", -1).alias("file"), F.expr("slice(parts, 1, size(parts) - 1)").alias("dirs"))
    rows = rows.where(f"NOT exists(dirs, d -> {_ignored('d')})")
    ending = F.lower(F.regexp_extract("file", r"[^.].*\.([^.]+)$", 1))
    code = ending.isin(*CODE_ENDINGS)
    rows = rows.select("dirs", code.cast("int").alias("code"), (~code & ending.isin(*DOC_ENDINGS)).cast("int").alias("doc"))
    # one row for each folder above a file: its own counts for the last of them alone
    above = rows.groupBy("dirs").agg(F.count("*").alias("n"), F.sum("code").alias("code"), F.sum("doc").alias("doc"))
    up = above.select(F.expr("explode(transform(sequence(0, size(dirs)), i -> struct(slice(dirs, 1, i) AS d, i = size(dirs) AS own)))").alias("f"), "n", "code", "doc")
    own = lambda c: F.sum(F.when(F.col("f.own"), F.col(c)).otherwise(0))
    found = up.groupBy(F.col("f.d").alias("d")).agg(own("n").alias("files"), own("code").alias("code_files"), own("doc").alias("doc_files"), F.sum("n").alias("all_files"), F.sum("code").alias("all_code"), F.sum("doc").alias("all_docs"))
    below = found.where("size(d) > 0").groupBy(F.expr("slice(d, 1, size(d) - 1)").alias("d")).agg(F.count("*").alias("subdirs"))
    out = found.join(below, "d", "left").where(f"size(d) BETWEEN 1 AND {int(depth)}")
    out = out.select(F.array_join("d", "/").alias("path"), F.element_at("d", -1).alias("name"), F.size("d").alias("depth"), "files", "code_files", "doc_files", F.coalesce("subdirs", F.lit(0)).alias("subdirs"), "all_files", "all_code", "all_docs")
    return out if most is None else out.orderBy("depth", "path").limit(most)
