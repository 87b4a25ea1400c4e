import ast
import itertools
import random

from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import expand as X
from graphloom.operators import graph as G
from graphloom.operators import search as K
from graphloom.plans import catalog, jql, views
from graphloom.sources import code
from graphloom.streaming import events as E


def one(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()))
    return row.select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.name_tokens(F.col("n")), n="parseHTTPRequest_v2") == "parse http request v2"
    assert one(spark, S.path_prefixes(F.col("p")), p="a/b/c.py") == ["a/b", "a", ""]
    assert one(spark, S.path_prefixes(F.col("p")), p="c.py") == [""]
    assert one(spark, S.file_stem(F.col("p")), p="a/b.c/test_x.py") == "test_x"
    assert one(spark, S.snake(F.col("p")), p="HttpServerError") == "http_server_error"
    assert one(spark, S.layer(F.lit("main"), F.lit("function"), F.lit("src/x.py"), F.lit(None).cast("string"))) == "entry_point"
    for path, want in [("tests/a.py", True), ("src/test_a.py", True), ("a/b_test.go", True), ("x.spec.ts", True), ("src/contest.py", True), ("src/contests_all.py", False), ("latest/a.py", False)]:
        assert one(spark, S.is_test_path(F.col("p")), p=path) == want, path
    assert one(spark, S.score_norm(F.lit(None).cast("double"))) == 0.0
    assert one(spark, S.section_cap(F.lit(1000))) == 9


def two_cliques(spark, n=5):
    rows = [(f"{c}{i}", f"{c}{j}", "calls") for c in "ab" for i, j in itertools.permutations(range(n), 2)] + [("a0", "b0", "calls")]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, rel_type string")
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "ab" for i in range(n)] + [("lone",)], "node_id string")
    return nodes, edges


def test_two_communities(spark):
    nodes, edges = two_cliques(spark)
    pairs = G.undirected(edges).withColumn("scope", F.lit(1))
    found = {r.node_id: r.community for r in X.communities(pairs, "scope").collect()}
    assert len(set(found.values())) == 2 and len({found[f"a{i}"] for i in range(5)}) == 1
    assert {r.component for r in G.weak_components(nodes, edges).collect()} == {"a0", "lone"}
    assert abs(G.pagerank(nodes, edges, 10).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert [r.node_id for r in G.orphans(nodes, edges).collect()] == ["lone"]
    hops = {r.node_id: r.hop for r in G.within_hops(edges, spark.createDataFrame([("a1",)], "node_id string"), 3, "out").collect()}
    assert hops["a1"] == 0 and hops["a0"] == 1 and hops["b0"] == 2 and hops["b3"] == 3


def test_louvain_is_deterministic():
    pairs = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 0.1), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0)]
    assert X.louvain(pairs) == X.louvain(pairs) == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1}


def test_jql_parsing():
    q = jql.parse('type:class bogus:x stray name:"Foo Bar" OR connections:>=5 limit:900')
    assert q.limit == 500 and [[(c.field, c.op, c.value) for c in a] for a in q.alternatives] == [[("type", "", "class"), ("name", "", "Foo Bar")], [("connections", ">=", "5")]]
    assert len(jql.parse("type:a OR type:b", strict=True).alternatives) == 1
    assert jql.is_jql("type:class") and not jql.is_jql("see http: what")
    assert jql.from_question("Find functions in src/auth/ that handle login") == 'type:function file:src/auth/ text:"handle login"'


def test_fusion_needs_both_lists(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id int, rank int")
    got = {r.doc_id: r.score for r in K.rrf([(a, 1.0), (b, 1.0)], "doc_id").collect()}
    assert max(got, key=got.get) == 2 and [d for d, s in got.items() if s >= 0.02] == [2]
    assert K.keywords("How does the getUserName function work?") == ["does", "getusername", "get", "user", "name", "function", "work"]


def test_budgets(spark):
    items = spark.createDataFrame([("p", i, c) for i, c in enumerate([60, 50, 30, 20, 5])], "page string, i int, cost int")
    assert sorted(r.i for r in X.greedy_budget(items, "page", ["i"], "cost", 100).collect()) == [0, 2, 4]
    assert {r.i: r.tier for r in X.tiers(items, "page", ["i"], "cost", ((1.0, 60), (0.5, 40))).collect()} == {0: 1, 1: 2, 2: 2, 3: 0, 4: 0}


def test_source_files(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/m.py").write_text("import os\nclass A(Base):\n    '''Doc.'''\n    def f(self):\n        return g()\ndef g():\n    return A()\n")
    (tmp_path / "pkg/bad.py").write_text("def (:\n")
    (tmp_path / "README.md").write_text("intro\n# One\ntext\n## Two\nmore\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.py").write_text("x = 1\n")
    found = code.files(spark, str(tmp_path))
    assert sorted(r.rel_path for r in found.collect()) == ["README.md", "pkg/bad.py", "pkg/m.py"]
    items = code.parsed(found)
    assert {(r.name, r.kind) for r in items.where("item = 'symbol'").collect()} == {("A", "class"), ("f", "method"), ("g", "function")}
    edges = {(r.source_id, r.target_id, r.rel_type) for r in code.resolved(items).collect()}
    assert edges == {("python::m::A", "python::m::A.f", "defines"), ("python::m::A.f", "python::m::g", "calls"), ("python::m::g", "python::m::A", "creates")}
    assert [(r.section, r.title) for r in code.sections(found).orderBy("section").collect()] == [(0, ""), (1, "One"), (2, "Two")]
    nodes = items.where("item = 'symbol'").select(F.col("id").alias("node_id"), "name")
    code.save_graph(nodes, code.resolved(items), str(tmp_path / "snap"))
    back, _ = code.load_graph(spark, str(tmp_path / "snap"))
    assert back.count() == 3
    assert ast.parse("1")


def test_stream_upserts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    stream = spark.readStream.schema("id int, v string").parquet(source)
    q = E.upsert_stream(stream, str(tmp_path / "out"), "id", str(tmp_path / "cp"))
    q.processAllAvailable()
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_stream_windows(spark, sf_dir):
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = E.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = E.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).count()
    assert spark.table("counts").count() == want


def test_overlaps_of_the_whole_tables(spark, tmp_path):
    """No order (here none is divisible by 50) and no customer or part beyond 100 may be left out or folded together."""
    orders = [(o, c) for o, c in [(1, 1), (2, 41), (3, 2), (7, 1), (51, 300), (99, 400)]]
    items = [(1, 5), (1, 105), (7, 6), (2, 5), (2, 105), (2, 9), (3, 205), (51, 5), (51, 6), (51, 6), (99, 777)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    customer, pages = dict(orders), {}
    for o, part in items:
        pages.setdefault(customer[o], set()).add(part)
    want = {(a, b, len(pages[a] & pages[b])) for a, b in itertools.combinations(sorted(pages), 2) if 2 * len(pages[a] & pages[b]) > min(len(pages[a]), len(pages[b]))}
    assert {(1, 41, 2), (1, 300, 2)} == want
    assert {tuple(r) for r in catalog.QUERIES["overlap_pairs_all"](spark, str(tmp_path)).collect()} == want


def tables(spark, path, **given):
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_alias_chains_of_all_orders(spark, tmp_path):
    keys = [1, 2, 7, 8, 14, 49, 50, 98, 343, 344, 2401, 2402, 16807, 16808, 117649]
    tables(spark, tmp_path, orders=([(k,) for k in keys], "o_orderkey long"))
    want = set()
    for k in keys:
        at, hops = k // 7, 1
        while at in keys and hops < 5:
            at, hops = at // 7, hops + 1
        want.add((f"o:{k}", f"o:{at}", hops))
    assert max(h for _, _, h in want) == 5
    assert {tuple(r) for r in catalog.QUERIES["alias_chain_all"](spark, str(tmp_path)).select("source_id", "resolved", "hops").collect()} == want


def test_anchors_of_all_nodes(spark, tmp_path):
    """Orphans and anchors of every type; orders not divisible by 20 count."""
    tables(
        spark, tmp_path,
        region=([(0, "A"), (1, "B")], "r_regionkey long, r_name string"),
        nation=([(3, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        customer=([(1, "x", 3), (11, "y", 3)], "c_custkey long, c_name string, c_nationkey long"),
        supplier=([(5, "s", 3)], "s_suppkey long, s_name string, s_nationkey long"),
        part=([(2, "p"), (12, "q"), (4, "t")], "p_partkey long, p_name string"),
        orders=([(7, 1), (9, 1), (13, 11)], "o_orderkey long, o_custkey long"),
        lineitem=([(7, 2, 5), (9, 2, 5)], "l_orderkey long, l_partkey long, l_suppkey long"),
    )
    spark_nodes = {r.node_id: r.rel_path for r in views.nodes(spark, str(tmp_path)).collect()}
    degree = dict.fromkeys(spark_nodes, 0)
    for r in views.edges(spark, str(tmp_path)).collect():
        degree[r.source_id] += 1
        degree[r.target_id] += 1
    want = set()
    for n in (n for n, d in degree.items() if not d):
        parts = spark_nodes[n].split("/")[:-1]
        for depth in range(len(parts) + 1):
            above = "/".join(parts[: len(parts) - depth])
            near = [(degree[m], m) for m, p in spark_nodes.items() if degree[m] and (p.startswith(f"{above}/") or not above)]
            if near:
                want.add((n, max(near)[1], depth))
                break
    assert {w[0] for w in want} == {"r:1", "p:12", "p:4"} and ("p:12", "p:2", 0) in want and ("p:4", "p:2", 1) in want
    assert {tuple(r) for r in catalog.QUERIES["nearest_ancestor_anchor_all"](spark, str(tmp_path)).collect()} == want


def test_components_against_union_find_and_rounds(spark):
    import random

    from graphloom.operators.components import components

    def smallest(edges):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
        return {x: top(x) for x in up}

    rng = random.Random(7)
    path, ring = [(i, i + 1) for i in range(40)], [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)]
    odd = [(1, 1), (None, 3), (300, None), (5, 4), (5, 4), (400, 350), (400, 360), (360, 355)]
    edges = path + ring + loose + odd
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == smallest(edges)
    # stars around their smallest nodes need no round; a centre that is not the smallest, and a path, do
    stars = spark.createDataFrame([(1, 7), (8, 1), (1, 9), (3, 4)], "a long, b long")
    assert {r.node: r.component for r in components(stars, max_rounds=1).collect()} == {1: 1, 7: 1, 8: 1, 9: 1, 3: 3, 4: 3}
    for more in ([(5, 6), (6, 7)], [(9, 5), (9, 6)]):
        try:
            components(spark.createDataFrame(more, "a long, b long"), max_rounds=1)
        except RuntimeError:
            continue
        raise AssertionError(more)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps_count_no_rows_of_two_pages_and_a_symbol(spark, monkeypatch):
    """A symbol of more pages than a list holds pairs them all; pairs are counted from lists, with no aggregation by pair."""
    rng = random.Random(8)
    pages = {g: {0} | {rng.randrange(1, 6) for _ in range(rng.randrange(4))} for g in range(40)}
    want = {(a, b, len(pages[a] & pages[b])) for a, b in itertools.combinations(pages, 2) if 2 * len(pages[a] & pages[b]) > min(len(pages[a]), len(pages[b]))}
    monkeypatch.setattr(X, "PAGES_AT_ONCE", 7)
    for name, kind in ((int, "long"), ("p{:02d}".format, "string")):
        found = X.overlaps(spark.createDataFrame([(name(g), x) for g, xs in pages.items() for x in xs], f"g {kind}, x long"))
        assert {tuple(r) for r in found.collect()} == {(name(a), name(b), n) for a, b, n in want}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "HashAggregate" not in plan


def test_edges_are_made_distinct_in_parts_of_bounded_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(G, "ROWS_AT_ONCE", 100)
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100)
    plan = G.degrees(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert all(any(key in line and f", {parts}), REPARTITION_BY_NUM" in line for line in plan.splitlines()) for key in ("l_orderkey", "l_partkey"))
