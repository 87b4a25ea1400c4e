"""Sections, folder trees, text stores, folders as a source, vector lists: against plain Python."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import sections as C
from graphloom.operators import tree as T
from graphloom.operators import vector_index
from graphloom.operators.vector_index import VectorIndex, fitted, measured_probes
from graphloom.sources import docstore
from graphloom.sources.discovery import FolderReader, FolderSource


def _chunks(body, kind, stem, whole):
    """(order, type, summary, path of headings, content, start, end) line by line."""
    lines = body.split("\n")
    if len(body) <= whole:
        return [(0, f"{kind}_document", stem, (None,) * 4, body, 1, len(lines))]
    found, stack, fenced = [[0, {}, []]], {}, False
    for i, line in enumerate(lines):
        if kind == "markdown" and re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        elif kind == "markdown" and not fenced and (m := re.match(r"(#{1,4})(?:[ \t]|$)", line)):
            stack = {k: v for k, v in stack.items() if k < len(m[1])} | {len(m[1]): re.sub(r"^#+\s*|\s*#*\s*$", "", line).strip(" ")}
            found.append([i, stack, []])
        found[-1][2].append(line)
    if len(found) > 1:
        found = [f for j, f in enumerate(found) if j or re.search(r"\S", "\n".join(f[2]))]
        return [(j, "markdown_section", own[max(own)] if own else (x[0].strip(" ").lstrip("# ") if x[0].strip(" ").startswith("#") else f"Section {j + 1}"), tuple(own.get(k) for k in range(1, 5)), "\n".join(x), at + 1, at + len(x)) for j, (at, own, x) in enumerate(found)]
    step = 50 if kind == "markdown" else 30
    parts = [(i, lines[i : i + step]) for i in range(0, len(lines), step)]
    parts = [(i, x) for i, x in parts if re.search(r"\S", "\n".join(x))]
    first = lambda x: next(y.strip(" ") for y in x if y.strip(" "))
    return [(j, "text_chunk", first(x)[:50] + "..." * (len(first(x)) > 50), (None,) * 4, "\n".join(x), i + 1, i + len(x)) for j, (i, x) in enumerate(parts)]


def test_sections_by_brute_force(spark):
    rng = random.Random(4)
    pieces = ["# One", "## Two ##", "### Three", "#### Four", "##### five", "#no", "##", "```", "~~~ x", "words and words " * 3, "", "  # indented", "plain", "x" * 90]
    rows = [(f"k{i}", f"docs/file{i}.md", rng.choice(["markdown", "markdown", "text"]), "\n".join(rng.choices(pieces, weights=[2, 2, 2, 2, 1, 1, 1, 1, 1, 9, 5, 1, 9, 1], k=rng.randint(0, 160)))) for i in range(60)]
    rows += [("none", "a/b.rst", "text", None), ("empty", "c.md", "markdown", ""), ("blank", "d.txt", "text", "\n" * 700), ("first", "e.md", "markdown", "# T\n" + "y\n" * 400), ("flat", "f.md", "markdown", "y z\n" * 220), ("deep", "g.md", "markdown", "\n".join(f"{'#' * (1 + i % 4)} h{i}\ntext" for i in range(6_000)))]
    got = {}
    for r in C.chunked(spark.createDataFrame(rows, "k string, path string, kind string, text string").repartition(5), "k", "path", "kind", whole=500).collect():
        got.setdefault(r.k, []).append((r.section_order, r.section_type, r.summary, tuple(r.headers), r.content, r.start_line, r.end_line))
    for k, path, kind, text in rows:
        assert sorted(got.get(k, []), key=lambda x: x[0]) == _chunks(text or "", kind, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], 500), k
    assert C.chunked(spark.createDataFrame([], "k string, path string, kind string, text string"), "k", "path", "kind").count() == 0


def test_folder_tree_by_brute_force(spark):
    rng = random.Random(9)
    names = ["src", "lib", "a", "b", "_x", ".git", ".github", "node_modules", "x.egg-info", "docs", "target"]
    paths = [None, "", "README.md", "./a/b.py", "a//c.PY", ".env"] + ["/".join([*rng.choices(names, k=rng.randint(0, 7)), rng.choice(["m.py", "n.go", "r.md", "q", ".hidden", "z.tar.gz", "c.json"])]) for _ in range(600)]
    own, everything, below = {}, {}, {}
    for p in paths:
        parts = [x for x in re.sub(r"^(\./)+", "", p or "").split("/") if x]
        dirs = parts[:-1]
        if not parts or any(d in T.IGNORED or (d[0] == "." and d not in T.SHOWN_DOTS) or d[0] == "_" or d.endswith(".egg-info") for d in dirs):
            continue
        ending = os.path.splitext(parts[-1])[1][1:].lower()
        what = ("code",) if ending in T.CODE_ENDINGS else ("doc",) if ending in T.DOC_ENDINGS else ()
        for i in range(len(dirs) + 1):
            d = tuple(dirs[:i])
            own.setdefault(d, Counter()), everything.setdefault(d, Counter()).update(("n", *what))
            if i:
                below.setdefault(d[:-1], set()).add(d)
        own[tuple(dirs)].update(("n", *what))
    want = sorted([(len(d), "/".join(d), d[-1], own[d]["n"], own[d]["code"], own[d]["doc"], len(below.get(d, ())), everything[d]["n"], everything[d]["code"], everything[d]["doc"]) for d in own if d and len(d) <= 5])
    files = spark.createDataFrame([(p,) for p in paths], "rel_path string").repartition(4)
    rows = lambda df: sorted((r.depth, r.path, r.name, r.files, r.code_files, r.doc_files, r.subdirs, r.all_files, r.all_code, r.all_docs) for r in df.collect())
    assert rows(T.folder_tree(files)) == want and len(want) > 50
    assert rows(T.folder_tree(files, depth=3, most=20)) == [w for w in want if w[0] <= 3][:20]
    assert T.folder_tree(files.limit(0)).count() == 0


def test_text_store(spark, tmp_path):
    rows = [(f"d{i:04d}", f"text {i} é𝄞\n" * (i % 50), f'{{"n": {i}}}' if i % 3 else None) for i in range(500)] + [("null", None, None), (None, "lost", None), ("d0007", "zzz a later text", "x"), ("long", "x" * 3_000_000, "")]
    docs = spark.createDataFrame(rows, "id string, text string, metadata string").repartition(4)
    folder = f"file://{tmp_path}/s"
    index = docstore.write_docstore(docs, folder, 20_000)
    assert index.count() == 502 and index.select("file").distinct().count() > 10
    want = {r[0]: ((r[1] or ""), r[2]) for r in rows if r[0] and r[1] != "zzz a later text"}
    ids = spark.createDataFrame([(k,) for k in want] + [("d0001",), ("absent",), (None,)], "id string")
    got = docstore.fetch(spark, folder, ids).collect()
    assert len(got) == len(want) and {r.id: (r.text, r.metadata) for r in got} == want
    assert docstore.fetch_one(spark, folder, "d0049") == want["d0049"][0] and docstore.fetch_one(spark, folder, "absent") is None
    plan = index.where(F.col("id") == "d0049")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,d0049)" in plan
    entry = index.where("id = 'd0049'").first()
    path = f"{tmp_path}/s/bytes/{entry.file}"
    raw = bytearray(open(path, "rb").read())
    raw[entry.offset + 3] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(docstore.BrokenDocstore):
        docstore.fetch_one(spark, folder, "d0049")
    with pytest.raises(Exception, match="BrokenDocstore"):
        docstore.fetch(spark, folder, ids).collect()
    empty = docstore.write_docstore(docs.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and docstore.fetch(spark, f"file://{tmp_path}/e", ids).count() == 0


def test_folders_as_a_source(spark, tmp_path, monkeypatch):
    for path, text in {"a.py": "one", "src/b.py": "two", "src/deep/c.PY": "three", "src/deep/d.md": "four", "node_modules/x/e.py": "no", ".git/f.py": "no", "out/g.py": "no", "src/skip_h.py": "no", "src/big.py": "y" * 5_000, "src/bad.py": b"\xff\xfe"}.items():
        where = tmp_path / path
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(text if isinstance(text, bytes) else text.encode())
    spark.dataSource.register(FolderSource)
    read = spark.read.format("folder").option("maxBytes", "4000").option("exclude", "out,*/skip_*").option("foldersAtOnce", "1")
    got = {r.rel_path: (r.length, r.skipped, r.content) for r in read.load(str(tmp_path)).collect()}
    assert got == {"a.py": (3, False, "one"), "src/b.py": (3, False, "two"), "src/deep/c.PY": (5, False, "three"), "src/deep/d.md": (4, False, "four"), "src/big.py": (5000, True, None), "src/bad.py": (2, False, "��")}
    only = read.option("endings", ".py").option("include", "src/*").option("contents", "false").load(f"file://{tmp_path}")
    assert {r.rel_path: r.content for r in only.collect()} == dict.fromkeys(["src/b.py", "src/deep/c.PY", "src/big.py", "src/bad.py"])
    listed = []
    real = FolderReader._listed

    def seen(self, where, top, folder):
        listed.append(folder)
        if folder.startswith(("node_modules", ".git", "out")):
            raise PermissionError(folder)  # a folder that is left out may not be readable
        return real(self, where, top, folder)

    monkeypatch.setattr(FolderReader, "_listed", seen)
    parts = FolderReader({"path": str(tmp_path), "exclude": "out", "foldersAtOnce": "2"}).partitions()
    assert [p.folders for p in parts] == [["", "src"], ["src/deep"]] and sorted(listed) == ["", "src", "src/deep"]


def _vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(40, dim)) * 3
    return [(f"v{i:05d}", (middles[i % 40] + rng.normal(size=dim)).tolist()) for i in range(n)]


def test_vector_lists(spark, tmp_path):
    rows = _vectors(4_000, 16)
    frame = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
    index = VectorIndex.build(frame, f"file://{tmp_path}/v", lists=40)
    assert index.vectors().count() == 4_000 and index.probes < 20
    asked = frame.where("substr(id, 5, 2) = '00' OR substr(id, 4, 3) = '050'")
    ids, known = [r[0] for r in rows], np.array([r[1] for r in rows])

    def exact(q, k=10, without=()):
        d = np.sqrt(((known - np.array(q)) ** 2).sum(1))
        return [ids[i] for i in np.lexsort((np.array(ids), d)) if ids[i] not in without][:k]

    def found(index, probes=None, k=10):
        out = {}
        for r in index.search(asked, k, probes).collect():
            out.setdefault(r["query"], {})[r["rank"]] = r.id
        return {q: [x[i] for i in sorted(x)] for q, x in out.items()}

    queries = {r.id: r.embedding for r in asked.collect()}
    want = {q: exact(v) for q, v in queries.items()}
    assert len(want) > 20 and found(index, 40) == want  # all lists: exact
    again = VectorIndex.load(spark, f"file://{tmp_path}/v")
    assert again.probes == index.probes and np.allclose(again.centres, index.centres)
    near = found(again)
    recall = np.mean([len(set(near[q]) & set(want[q])) / 10 for q in want])
    assert recall >= 0.9, recall
    gone = spark.createDataFrame([(want[q][0],) for q in want] + [("absent",)], "id string")
    index.delete(gone)
    without = {want[q][0] for q in want}
    assert index.vectors().count() == 4_000 - len(without)
    assert found(index, 40) == {q: exact(v, without=without) for q, v in queries.items()}
    index.add(frame.join(gone, "id", "left_semi"))  # back again
    assert found(VectorIndex.load(spark, f"file://{tmp_path}/v"), 40) == want
    read = index.search(asked.limit(1), 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in read.lower()  # only the lists that a query needs are read


def test_vector_lists_at_the_edges(spark, tmp_path):
    same = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(50)] + [(None, [0.0, 0.0]), ("x", None)], "id string, embedding array<double>")
    index = VectorIndex.build(same, f"file://{tmp_path}/a", lists=5)
    assert index.vectors().count() == 50
    assert [r.id for r in index.search(same.where("id = '7'"), 3, 5).orderBy("rank").collect()] == ["0", "1", "10"]  # ties by id
    one = VectorIndex.build(same.where("id = '7'"), f"file://{tmp_path}/b")
    assert [(r.id, r.distance) for r in one.search(same.where("id = '8'"), 3).collect()] == [("7", 0.0)]
    none = VectorIndex.build(same.limit(0), f"file://{tmp_path}/c")
    assert none.vectors().count() == 0


def test_lists_meet_queries_in_blocks(spark, tmp_path, monkeypatch):
    """No row is made of a query and a vector: small blocks give what one block gives, and the plan joins no such pairs."""
    rows = _vectors(600, 8, 4) + [(f"w{i}", [1.0] * 8) for i in range(30)]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>")
    index = VectorIndex.build(frame, f"file://{tmp_path}/v", lists=3)
    asked = frame.where("id LIKE '%7'")
    whole = sorted(map(tuple, index.search(asked, 9, 3).collect()))
    monkeypatch.setattr(vector_index, "VECTORS_AT_ONCE", 50)
    monkeypatch.setattr(vector_index, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(vector_index, "CELLS_AT_ONCE", 100)
    search = index.search(asked, 9, 3)
    assert sorted(map(tuple, search.collect())) == whole and len(whole) == 9 * asked.count()
    assert "CoGroupsInArrow" in search._jdf.queryExecution().executedPlan().toString()
    known = {q: np.array(v) for q, v in rows}
    want = {q: sorted((np.sqrt(((known[q] - v) ** 2).sum()), i) for i, v in known.items())[:9] for q in [r.id for r in asked.collect()]}
    assert [(q, i) for q, i, _, r in sorted(whole, key=lambda x: (x[0], x[3]))] == [(q, i) for q in sorted(want) for _, i in want[q]]


def test_lists_to_read_are_measured():
    sample = np.array([r[1] for r in _vectors(1_000, 8, 3)])
    centres = fitted(sample, 20)
    few, many = measured_probes(sample, centres, 0.5), measured_probes(sample, centres, 1.0)
    assert 1 <= few <= many <= 20
