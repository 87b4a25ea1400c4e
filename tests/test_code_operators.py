"""Operators over code-like graphs against their definitions in plain Python."""

import itertools
import json
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import clustering as C
from graphloom.operators import expand as X
from graphloom.operators import fts
from graphloom.operators import graph as G
from graphloom.operators import linkage as L
from graphloom.operators import orphans as O
from graphloom.operators import ranking as R
from graphloom.operators import resolve as V
from graphloom.operators import surfaces as U
from graphloom.sources.stores import GraphStore, Registry, embedded

NODE = "node_id string, symbol_name string, symbol_type string, rel_path string, file_name string, language string, parent_symbol string, start_line int, end_line int, source_text string, docstring string"


def node(i, name=None, kind="function", path="src/main.py", lang="python", parent=None, line=0, text="", doc=""):
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return (i, name or i, kind, path, stem, lang, parent, line, line + 5, text, doc)


def nodes_of(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def edges_of(spark, *rows):
    return spark.createDataFrame([(*r, "structural") if len(r) == 3 else r for r in rows], "source_id string, target_id string, rel_type string, edge_class string")


def random_graph(rng, n, m):
    names = [f"v{i:03d}" for i in range(n)]
    return names, [(rng.choice(names), rng.choice(names), "calls") for _ in range(m)]


def test_pagerank_reads_its_edges_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    names, rows = random_graph(random.Random(4), 30, 50)
    edges = edges_of(spark, *rows)
    G.pagerank(spark.createDataFrame([(v,) for v in names], "node_id string"), edges.mapInArrow(seen, edges.schema), 5).collect()
    assert reads.value == len(rows)


def test_weights_by_class(spark):
    e = edges_of(spark, ("a", "t", "calls"), ("b", "t", "calls"), ("c", "t", "calls", "directory"), ("d", "lone", "x", "doc"))
    got = {(r.source_id, r.target_id): r.weight for r in G.edge_weights(e).collect()}
    assert got["a", "t"] == pytest.approx(1 / math.log(4)) and got["c", "t"] == pytest.approx(max(0.5, 1 / math.log(4)))
    assert got["d", "lone"] == pytest.approx(1 / math.log(2))
    many = edges_of(spark, *[(f"s{i}", "t", "calls") for i in range(60)], ("o", "t", "x", "lexical"))
    assert {r.weight for r in G.edge_weights(many).where("edge_class = 'lexical'").collect()} == {0.5}


def test_pagerank_of_twenty_rounds_and_components_on_a_whole_graph(spark):
    names, rows = random_graph(random.Random(3), 60, 70)
    names.append("alone")
    nodes, edges = spark.createDataFrame([(v,) for v in names], "node_id string"), edges_of(spark, *rows)
    pairs = Counter(tuple(sorted(r[:2])) for r in rows)
    arcs = Counter()
    for (a, b), w in pairs.items():
        arcs[a, b] += w
        if a != b:
            arcs[b, a] += w
    total = Counter()
    for (a, _), w in arcs.items():
        total[a] += w
    n = len(names)
    rank = dict.fromkeys(names, 1 / n)
    for _ in range(20):
        loose = sum(rank[v] for v in names if not total[v])
        new = {v: 0.15 / n + 0.85 * loose / n for v in names}
        for (a, b), w in arcs.items():
            new[b] += 0.85 * rank[a] * w / total[a]
        rank = new
    got = {r.node_id: r["rank"] for r in G.pagerank(nodes, edges).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-12 for v in names)
    label = {v: v for v in names}
    for _ in names:
        for a, b, _ in rows:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node_id: r.component for r in G.weak_components(nodes, edges).collect()} == label


def test_bridges_go_to_the_most_similar_larger_component(spark):
    nodes = nodes_of(spark, *[node(f"a{i}", path="x/a.py") for i in range(4)], *[node(f"b{i}", path="y/b.py") for i in range(3)], *[node(f"c{i}", path="y/c.py") for i in range(2)], node("d0", path="z/d.py"))
    edges = edges_of(spark, *[("a0", f"a{i}", "calls") for i in range(1, 4)], ("b0", "b1", "calls"), ("b1", "b2", "calls"), ("c0", "c1", "calls"))
    got = {(r.source_id, r.target_id) for r in L.bridges(nodes, edges).collect()}
    assert got == {("b1", "a0"), ("a0", "b1"), ("c1", "b1"), ("b1", "c1"), ("d0", "a0"), ("a0", "d0")}


def test_paths_of_references(spark):
    rows = [("../a/b.py", "docs/guide", "docs/a/b.py"), ("./x.md", "docs", "docs/x.md"), ("http://x.y/z", "d", ""), ("#top", "d", ""), ("x.md#part", "", "x.md"), ("../../up.py", "a", "../up.py"), ("mailto:a@b.c", "d", ""), ("/root.md", "d", "root.md")]
    df = spark.createDataFrame(rows, "ref string, dir string, want string")
    assert all(r.got == r.want for r in df.select("want", L.resolved_path(F.col("ref"), F.col("dir")).alias("got")).collect())


def test_queries_are_rendered():
    assert fts.rendered(fts.symbol_resolution("AuthService")) == 'symbol_name:"authservice"* OR name_tokens:"auth" "service"'
    assert fts.rendered(fts.concept(["authentication", "token"])) == '"authentication"* OR "token"* OR docstring:"authentication" OR docstring:"token"'
    assert fts.keywords("How does authentication work?") == ["authentication"]
    assert fts.keywords("AuthServiceManager login flow") == ["authservicemanager", "auth", "service", "manager", "login", "flow"]
    assert fts.rendered(fts.phrase_query("dependency injection", "docstring")) == 'docstring:"dependency injection"'
    assert fts.for_vectors("payment processing", ["billing", "stripe"]) == "payment processing billing stripe"
    assert fts.from_question("") == [] and fts.rendered(fts.from_question("get_user", "symbol")) == 'symbol_name:"get user"* OR name_tokens:"get" "user"'


def test_phrases_and_scores(spark):
    docs = spark.createDataFrame([("1", "red bolt and red ring"), ("2", "bolt red"), ("3", ""), ("4", "redder bolts")], "node_id string, text string")
    index = fts.build(docs, "node_id", {"text": F.col("text")})
    ids = lambda q: [r.node_id for r in fts.search(index, q).collect()]
    assert ids([[fts.phrase("red bolt")]]) == ["1"] and sorted(ids([[fts.phrase("red", True)]])) == ["1", "2", "4"]
    assert sorted(ids([[fts.phrase("red"), fts.phrase("bolt")]])) == ["1", "2"] and ids([[fts.phrase("absent")]]) == [] and ids([]) == []
    (r,) = fts.search(index, [[fts.phrase("ring")]]).collect()
    idf = max(1e-6, math.log((4 - 1 + 0.5) / 1.5))
    assert r.score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / (9 / 4))))


def test_resolution_in_order_of_preference(spark):
    n = nodes_of(spark, node("1", "Foo", "class", "a/x.py"), node("2", "Foo", "function", "b/y.py"), node("3", "Foo", "class", "b/z.go", "go"), node("4", "bar", path="a/x.py")).withColumn("full_name", F.concat(F.lit("pkg.sub."), "symbol_name", F.col("node_id")))
    asked = spark.createDataFrame([("Foo", "b/y.py", "python"), ("pkg.Foo", "a/x.py", "python"), ("pkg.sub.Foo3", "", ""), ("sub.bar4", "", ""), ("Foo", "", "go"), ("Foo", "", ""), ("none", "", ""), ("  ", "", "")], "name string, file string, language string")
    got = {(r.name, r.file, r.lang): (r.node_id, r.tier) for r in V.resolved(asked, n).collect()}
    assert got == {("Foo", "b/y.py", "python"): ("2", 1), ("pkg.Foo", "a/x.py", "python"): ("1", 2), ("pkg.sub.Foo3", "", ""): ("3", 3), ("sub.bar4", "", ""): ("4", 4), ("Foo", "", "go"): ("3", 5), ("Foo", "", ""): ("1", 5), ("none", "", ""): (None, None)}


def test_relationships_by_hops(spark):
    e = edges_of(spark, ("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("z", "a", "uses"))
    start = spark.createDataFrame([("a",)], "node_id string")
    got = {(r.source_id, r.target_id, r.hop) for r in V.relationships(e, start).collect()}
    assert got == {("a", "b", 1), ("z", "a", 1), ("b", "c", 2)}
    assert V.relationships(e, start, "incoming").count() == 1 and V.relationships(e, start, most=1).count() == 1


def test_fold_to_cap():
    sizes, links = {0: 10, 1: 5, 2: 1, 3: 4}, {(0, 2): 1.0, (1, 2): 3.0, (1, 3): 1.0, (0, 3): 1.0}
    assert C.fold_to_cap(sizes, links, 4) == {0: 0, 1: 1, 3: 2, 2: 3}
    assert C.fold_to_cap(sizes, links, 3) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert C.fold_to_cap(sizes, links, 2) == {0: 0, 3: 0, 1: 1, 2: 1}
    hist = {0: Counter(a=5), 1: Counter(a=1, b=2), 2: Counter(b=1), 3: Counter(c=9)}
    assert C.similarity_fold({k: sum(v.values()) for k, v in hist.items()}, hist, 3)[2] == 1


def test_pages_keep_to_their_sizes(spark):
    rng = random.Random(5)
    names = [f"{c}{i:02d}" for c in "abc" for i in range(30)] + ["tiny"]
    links = [(x, y, "calls") for c in "abc" for x, y in itertools.combinations([v for v in names if v[0] == c], 2) if rng.random() < 0.4] + [("a00", "tiny", "calls")]
    n = nodes_of(spark, *[node(v, path=f"src/{v[0]}.py", line=i) for i, v in enumerate(names)])
    section = spark.createDataFrame([(v, 0) for v in names], "node_id string, cluster int")
    got = {r.node_id: r.page for r in C.pages(n, edges_of(spark, *links), section, least=4, most=20).collect()}
    sizes = Counter(got.values())
    assert got.keys() == set(names) and max(sizes.values()) <= 20 and len(sizes) >= 5
    kept = {r.node_id: r.page for r in C.pages(n, edges_of(spark, *links), section, least=4, most=60).collect()}
    assert kept["tiny"] == kept["a00"] and min(Counter(kept.values()).values()) >= 4 and len(set(kept.values())) == 3


def test_clusters_of_two_packages(spark):
    rows = [node(f"{c}{i}", kind="class", path=f"{c}/f{i % 3}.py") for c in "xy" for i in range(9)] + [node("xm", kind="method", path="x/f0.py", parent="x0"), node("far", kind="class", path="x/lone.py"), node("hub", kind="class", path="h/hub.py")]
    links = [(f"{c}{i}", f"{c}{j}", "calls") for c in "xy" for i, j in itertools.permutations(range(9), 2)] + [("xm", "x1", "calls")] + [(f"y{i}", "hub", "calls") for i in range(9)]
    got = {r.node_id: (r.section, r.page) for r in C.clustered(nodes_of(spark, *rows), edges_of(spark, *links), spark.createDataFrame([("hub",)], "node_id string")).collect()}
    assert len(got) == len(rows) and got["xm"] == got["x0"] and got["hub"][0] == got["y0"][0]
    assert {got[f"x{i}"][0] for i in range(9)} == {got["far"][0]} != {got[f"y{i}"][0] for i in range(9)}


def test_directories():
    count = {"a/x": 30, "a/y": 25, "b/z": 3, "b/w": 12}
    got = C.normalized([["a/x", "a/y"], ["b/z"], ["b/w"]], count, 10, 40)
    assert sorted(map(sorted, got)) == [["a/x"], ["a/y"], ["b/w", "b/z"]]


def test_orphans_pass_by_pass(spark):
    n = nodes_of(
        spark,
        node("core", "Engine", "class", "src/core/engine.py"),
        node("user", "run", path="src/core/run.py"),
        node("guide", "guide", "markdown_document", "docs/guide.md", "markdown", text="see [it](../src/core/engine.py) and `Engine`"),
        node("plug", "Engineplug", "class", "src/core/plug.py"),
        node("note", "note", "module_doc", "src/core/note.md", "markdown", text="the Engineplug is used here"),
        node("lost", "zzz", "constant", "src/core/deep/z.py"),
        *[node(f"f{i}", f"filler{i}", path=f"src/o/{i}.py", text="words of no use") for i in range(60)],
    )
    e = edges_of(spark, ("user", "core", "calls"), *[(f"f{i}", f"f{(i + 1) % 60}", "calls") for i in range(60)])
    index = fts.build(n, "node_id", fts.symbol_columns(n))
    got = {(r.source_id, r.target_id, r.rel_type) for r in O.resolved(n, e, index).collect()}
    assert ("guide", "core", "explicit_ref") in got and ("plug", "note", "lexical_link") in got
    assert ("lost", "user", "directory_link") in got and not [x for x in got if x[0] == "guide" and x[2] != "explicit_ref"]
    done = O.completed(n, e, index)
    assert G.weak_components(n, done).select("component").distinct().count() == 1


def test_hybrid_needs_both_lists(spark):
    n = nodes_of(spark, node("o", "Alpha", "class", "p/o.py"), node("t", "x", path="p/t.py", text="about alpha"), node("u", "y", path="p/u.py"), node("w", "z", path="q/w.py", text="alpha"), *[node(f"f{i}", path=f"p/f{i}.py") for i in range(30)])
    vec = spark.createDataFrame([("o", [0.0, 0.0]), ("t", [0.1, 0.0]), ("u", [0.0, 0.2]), ("w", [0.05, 0.0])] + [(f"f{i}", [9.0, float(i)]) for i in range(30)], "node_id string, embedding array<double>")
    index = fts.build(n, "node_id", fts.symbol_columns(n))
    got = O.hybrid(n.where("node_id = 'o'"), n, index, vec).collect()
    assert [(r.source_id, r.target_id) for r in got] == [("o", "t")] and got[0].score == pytest.approx(2 / 61)


def test_nearest_vectors_are_exact(spark, monkeypatch):
    monkeypatch.setattr(O, "QUERIES_AT_ONCE", 7)
    rng = random.Random(2)
    rows = [(f"v{i:03d}", [rng.random() for _ in range(8)]) for i in range(200)]
    v = spark.createDataFrame(rows, "node_id string, embedding array<double>").repartition(3)
    got = {}
    for r in O.nearest_vectors(v.where("node_id < 'v020'").withColumnRenamed("node_id", "orphan"), v, 4).collect():
        got.setdefault(r.orphan, {})[r["rank"]] = r.node_id
    for name, own in rows[:20]:
        want = sorted(rows, key=lambda r: (math.dist(own, r[1]), r[0]))[:4]
        assert [got[name][i] for i in range(1, 5)] == [r[0] for r in want]


def test_surfaces():
    of = lambda text, lang, name="f", **k: [s for _, s, _ in U.surfaces(text, lang, name, **k)]
    assert of('@router.get("/items/")', "python", prefix="/api/v1") == ["GET /api/v1/items", "GET /items"]
    assert of('r = APIRouter(prefix="/x")\n@r.route("/a", methods=["POST", "PUT"])', "python") == ["POST /x/a", "PUT /x/a"]
    assert of('axios.post("/b"); fetch("/c", {method: "DELETE"}); fetch("/d")', "typescript") == ["DELETE /c", "GET /d", "POST /b"]
    assert of('@Get("x") y() {}', "typescript") == ["GET /x"] and of('r.GET("/g", h)', "go") == ["GET /g"]
    assert of('@GetMapping("/s")', "java") == ["GET /s"] and of('@Path("/p") @PUT', "java") == ["PUT /p"]
    assert of("service Svc { rpc Do (A) returns (B); }", "proto") == ["grpc:Svc/Do"] and of("class SvcServicer:\n  def Do(self, r): pass", "python") == ["grpc:Svc/Do"]
    assert of("type Query { a: Int }", "graphql") == ["gql:query"] and of('extern "C" fn hash() {}', "rust", "hash") == ["ffi:hash"]
    assert of('[DllImport("lib")] extern int hash();', "csharp", "hash") == ["ffi:lib", "ffi:hash"]
    shapes = {of(t, lang)[0] for t, lang in [("class Order:\n    orderId: int\n    name: str\n", "python"), ("interface Order { orderId: number; name: string }", "typescript"), ("type Order struct {\n  OrderId int `json:\"order_id\"`\n  Name string\n}", "go"), ("struct Order { order_id: u32, name: String }", "rust"), ("public class Order { private int orderId; private String name; }", "java"), ("record Order(int orderId, String name)", "java")]}
    assert shapes == {"obj:order#name,order_id"}
    assert of('@given("A user")', "python") == ["bdd:a user"] and of("  When it runs\n", "gherkin") == ["bdd:it runs"]
    assert of('@cli.command("build")', "python") == ["cli:build"] and of("", "python") == []
    assert U.parameters("Map<A, B> x, final int y") == ["x", "y"]


def test_surfaces_by_frames():
    of = lambda text, lang, name="f", **k: [s for _, s, _ in U.surfaces(text, lang, name, **k)]
    assert of('bp = Blueprint("x", __name__, url_prefix="/v")\n@bp.post("/v/a")\ndef a(): pass', "python") == ["POST /v/a"]
    assert of('client.request({ url: "/a", method: "PATCH" })', "javascript") == ["PATCH /a"]
    assert of('app.get("/u/", (q, r) => r.send(")"))', "javascript") == ["GET /u"] and of('app.get("setting")', "javascript") == []
    assert of('@RequestMapping(value = "/rest/v2beta1/z", method = RequestMethod.POST)', "java") == ["GET /rest/v2beta1/z", "GET /z"]
    assert of('@Controller\n@Path("/p")\nclass A { @GET public X get() {} @POST public X put() {} }', "java") == ["GET /p", "POST /p"]
    assert of("@Resolver(() => User)\nclass R { @Query(() => [User]) users() {} }", "typescript") == ["gql:resolver", "gql:query"]
    assert of('lib = ctypes.CDLL("l.so")\nlib.total(1)\nother.total2()', "python") == ["ffi:f", "ffi:total"]
    assert of("return lib.total(1) + lib.lost.deep(2)", "python", libraries={"lib"}) == ["ffi:total"]
    assert of("private native int hash(byte[] b);", "java", "hash") == ["ffi:hash"] and of("#[wasm_bindgen]\npub fn go() {}", "rust", "go") == ["ffi:go"]
    assert of('cmd := &cobra.Command{\n Use: "serve [flags]",\n Short: "x",\n}', "go") == ["cli:serve"]
    assert of('p.add_subparsers(dest="c").add_parser("run", help="x")', "python") == ["cli:run"] and of('@click.group(name="top")', "python") == ["cli:top"]
    assert of("public class A extends B implements C, D<E, F> { public int Total { get; set; } internal void M(int x) { int y = 1; } private Map<K, V> byKey = new X(); }", "csharp") == ["obj:a#by_key,total"]
    assert of("struct P { pub a_b: Vec<u8>, #[serde(rename = \"x\")] pub c: i32 }", "rust") == ["obj:p#a_b,x"]
    assert of("class T(Base):\n    a: int = 1\n    def f(self):\n        if x:\n            y = 2\n        else: z\nclass U:\n    b: str\n", "python") == ["obj:t#a", "obj:u#b"]
    assert U.snake("HTTPServerError2Go") == "http_server_error2_go" and U.normal_path("'a/b/'") == "/a/b" and U.normal_path("/") == "/"
    assert U.parameters("a: int, b") == ["int", "b"] and U.parameters("") == []


def test_surfaces_take_linear_time():
    for bad in ("APIRouter(", "&cobra.Command{", "{method: 'GET', url: ", "interface A { a: ", "@Path(\"/p\") @GET ", "'\\'", "class A { private ", "service S { rpc ", "x.", "<", "a,", ") ", "struct S { #[serde("):
        took = []
        for n in (2_000, 8_000):
            began = time.process_time()
            for lang in ("python", "typescript", "java", "go", "rust"):
                U.surfaces(bad * n, lang, "f")
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.5, (bad, took)


def test_surfaces_of_a_file(spark):
    rows = [node("a", path="x.py", text='r = APIRouter(prefix="/u")\nlib = ctypes.CDLL("l")'), node("b", path="x.py", text='@r.get("/me")\ndef me(): return lib.total()'), node("c", path="y.py", text='@r.get("/me")'), node("d", text=None), node("e", lang=None, text="service S { rpc R (A) }")]
    got = {(r.node_id, r.surface) for r in U.extracted(nodes_of(spark, *rows)).collect()}
    assert got == {("a", "ffi:a"), ("b", "GET /u/me"), ("b", "ffi:total"), ("c", "GET /me"), ("e", "grpc:S/R")}


def test_expansion_rules(spark):
    n = nodes_of(spark, node("c", kind="class"), *[node(f"b{i}", kind="class") for i in range(5)], node("m", kind="method"), node("made", kind="class"), node("f"), node("k", kind="constant"))
    e = edges_of(spark, *[("c", f"b{i}", "inheritance") for i in range(5)], ("c", "m", "defines"), ("m", "made", "creates"), ("c", "f", "references"), ("c", "k", "composition"), ("f", "c", "calls"))
    got = {(r.seed, r.other) for r in X.expanded_by_graph(n.where("node_id = 'c'"), n, e).collect()}
    assert got == {("c", "b0"), ("c", "b1"), ("c", "b2"), ("c", "made")}
    assert {r.other for r in X.expanded_by_graph(n.where("node_id = 'f'"), n, e).collect()} == {"c"}


def test_chunks_and_shorter_forms(spark):
    long = "\n".join(f"line {i} " + "x" * 300 for i in range(90))
    docs = spark.createDataFrame([("a", "short\ntext"), ("b", long), ("c", None), ("d", "\n" * 20_000)], "k string, text string")
    got = {}
    for r in R.line_chunks(docs, "k").collect():
        got.setdefault(r.k, []).append((r.chunk, r.start_line, r.end_line, r.content))
    assert got["a"] == [(0, 1, 2, "short\ntext")] and [x[:3] for x in sorted(got["b"])] == [(0, 1, 30), (1, 31, 60), (2, 61, 90)]
    assert "\n".join(x[3] for x in sorted(got["b"])) == long and "d" not in got
    code = "class A:\n    def one(self, x):\n        return x\n\n    def two(self):\n        pass\n"
    assert R.shortened(code, "class", "python", 2) == "class A:\n    def one(self, x):\n    def two(self):"
    assert "Methods: one, two" in R.shortened(code, "class", "python", 3, "A", "a.py") and R.shortened(code, "constant", "python", 2) == code
    assert R.shortened("x" * 600, "other", "python", 2) == "x" * 500 + "\n..."


def test_stores(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert store.read("nodes") is None and store.get("k", 7) == 7
    store.upsert_nodes(nodes_of(spark, node("a", kind="CLASS"), node("b", kind="README_document", path="tests/b.md")))
    flags = {r.node_id: (r.symbol_type, r.is_architectural, r.is_doc, r.is_test) for r in store.read("nodes").collect()}
    assert flags == {"a": ("class", True, False, False), "b": ("readme_document", True, True, True)}
    store.upsert_nodes(nodes_of(spark, node("a", "renamed", "class"), node("c")))
    assert {r.node_id: r.symbol_name for r in store.read("nodes").collect()} == {"a": "renamed", "b": "b", "c": "c"}
    edges = edges_of(spark, ("a", "b", "calls"), ("a", "c", "calls")).withColumn("edge_id", F.monotonically_increasing_id()).withColumn("weight", F.lit(1.0))
    store.append_edges(edges)
    store.append_edges(edges.limit(1))
    assert store.read("edges").count() == 3
    store.upsert_vectors(spark.createDataFrame([("a", [1.0]), ("c", [2.0])], "node_id string, embedding array<double>"))
    store.upsert_vectors(spark.createDataFrame([("a", [3.0])], "node_id string, embedding array<double>"))
    assert {r.node_id: r.embedding for r in store.read("vectors").collect()} == {"a": [3.0], "c": [2.0]}
    store.set_clusters(spark.createDataFrame([("a", 1, 2)], "node_id string, macro_cluster int, micro_cluster int"))
    store.set_hubs(spark.createDataFrame([("a", True, "1")], "node_id string, is_hub boolean, assignment string"))
    assert {r.node_id: (r.macro_cluster, r.micro_cluster, r.is_hub, r.hub_assignment) for r in store.read("nodes").collect()} == {"a": (1, 2, True, "1"), "b": (None, None, False, None), "c": (None, None, False, None)}
    assert store.replace(nodes_of(spark, node("a", kind="class"), node("b")), edges) == {"nodes": 2, "purged": 1}
    assert {(r.source_id, r.target_id) for r in store.read("edges").collect()} == {("a", "b")} and store.read("vectors").count() == 1
    store.set_weights(store.read("edges").select("edge_id", F.lit(0.25).alias("weight")))
    assert store.read("edges").first().weight == 0.25
    store.put("k", {"x": [1, 2]})
    assert store.get("k") == {"x": [1, 2]}
    store.export(f"{tmp_path}/out")
    other = GraphStore(spark, f"file://{tmp_path}/h")
    assert other.load(f"{tmp_path}/out") == {"nodes": 2, "purged": 0}


def test_registry(spark, tmp_path):
    own = Registry(GraphStore(spark, f"file://{tmp_path}/r"))
    assert own.list().count() == 0 and own.find("a:main") is None
    own.put("org/a:main:01234567", {"v": 1})
    own.put("org/a:dev", {"v": 2})
    own.put("org/a:dev", {"v": 3})
    assert own.find("org/a:main:01234567") == {"v": 1} and own.find("org/a:main:ffff") == {"v": 1} and own.find("org/a:dev")["v"] == 3
    assert own.remove("org/a:dev") and not own.remove("org/a:dev") and [json.loads(r.record) for r in own.list().collect()] == [{"v": 1}]


def test_embedding_in_batches(spark):
    n = nodes_of(spark, node("a", text="one"), node("b", text=" ", doc="two"), node("c", text="bad"), node("d"))

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    assert {r.node_id: r.embedding for r in embedded(n.repartition(1), embed, 1).collect()} == {"a": [3.0], "b": [3.0]}


def test_embeddings_and_failures_are_all_rows(spark, tmp_path):
    """One bad text costs no other of its batch its vector; what fails is kept with its error, and can be tried again."""
    rows = [node(f"n{i:03d}", text="" if i % 10 == 9 else f"bad {i}" if i % 7 == 3 else f"text\u200b{i}") for i in range(100)]

    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no " + texts[0])
        return [[float(len(t)), 1.0] for t in texts]

    store = GraphStore(spark, f"file://{tmp_path}/e")
    store.upsert_nodes(nodes_of(spark, *rows).repartition(3))
    texts = {r[0]: r[9] for r in rows if r[9]}
    bad = {k for k, t in texts.items() if "bad" in t}
    assert store.embed(embed, 16) == {"vectors": len(texts) - len(bad), "failures": len(bad)}
    failed = {r.node_id: r.error for r in store.read("failures").collect()}
    assert failed == {k: f"RuntimeError: no {texts[k]}" for k in bad}
    assert {r.node_id: r.embedding[0] for r in store.read("vectors").collect()} == {k: float(len(t)) for k, t in texts.items() if k not in bad}
    assert store.embed(lambda ts: [[0.0]] * len(ts), 16) == {"vectors": len(texts), "failures": 0} and store.read("failures").count() == 0
    short = store.embed(lambda ts: [[0.0]] * (len(ts) // 2 or 1), 16)
    assert short == {"vectors": len(texts), "failures": 0}  # too few vectors for a batch: text by text


def test_a_store_keeps_what_another_wrote(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/w")
    for i in range(4):
        store.write("t", spark.range(i + 1))
    held = store.read("t")
    store.write("t", spark.range(9))
    assert held.count() == 4 and store.read("t").count() == 9  # a reader of the version before still reads it
    assert len(store._versions("t")) == 2

    class Meanwhile(GraphStore):
        def _versions(self, table):
            found = super()._versions(table)
            self.seen = getattr(self, "seen", 0) + 1
            if self.seen == 1:
                GraphStore(spark, self.folder).write(table, spark.range(5))
            return found

    with pytest.raises(RuntimeError, match="another"):
        Meanwhile(spark, store.folder).write("t", spark.range(7))
    assert store.read("t").count() == 5
    store.spark.range(3).write.parquet(f"{store.folder}/t/unnamed")  # a write that died before it was named
    assert store.read("t").count() == 5


def test_first_line_of_a_docstring(spark):
    rows = [('"""Does it.\nMore."""', "Does it."), ("/** Args:\n * @param x\n * Real one\n */", "Real one"), (None, ""), ("# note\nuse it", "use it"), ("x" * 200, "x" * 117 + "...")]
    df = spark.createDataFrame(rows, "d string, want string")
    assert all(r.got == r.want for r in df.select("want", S.first_line(F.col("d")).alias("got")).collect())


def test_guards_of_speed(spark):
    rng = random.Random(1)
    pairs = [(f"n{c}_{i}", f"n{c}_{j}", 1.0) for c in range(3) for i in range(150) for j in rng.sample(range(150), 6)] + [("n0_0", "n1_0", 0.1), ("n1_0", "n2_0", 0.1)]
    began = time.time()
    found = X.louvain(iter(pairs))
    assert time.time() - began < 5 and len(found) == 450
    names, rows = random_graph(rng, 1000, 2000)
    nodes, edges = spark.createDataFrame([(v,) for v in names], "node_id string"), edges_of(spark, *rows)
    for warm in (False, True):
        began = time.time()
        G.edge_weights(edges).agg(F.sum("weight")).collect()
        G.hubs(nodes, edges).collect()
        took = time.time() - began
    assert warm and took < 6  # two seconds in one process; here with Spark's jobs


def test_patterns_of_declarations():
    from graphloom.sources import patterns

    texts = {
        "java": "package p;\nimport a.b.C;\n/** Doc. */\npublic class A extends B implements I, J {\n  private static final int K = 1;\n  public void run(int x) {\n    helper(x); new D(\"}\");\n  }\n}\ninterface I {}\n",
        "typescript": "import {x} from './x';\nexport class A extends B {\n  run(a: number): void {\n    move(a);\n  }\n}\nexport interface I { a: string }\nexport const f = (x: number) => x;\ntype T = string;\n",
        "go": "type S struct {\n a int\n}\nfunc (s *S) Run() {\n  help()\n}\nfunc main() {}\ntype I interface {}\n",
        "rust": "pub struct S { a: u32 }\nimpl T for S {\n    fn run(&self) { help(); }\n}\ntrait T {}\nfn main() {}\nmacro_rules! m { () => {} }\n",
        "cpp": "#include <x.h>\n#define M 1\nnamespace n {\nclass A : public B {\n  int f(int x) const {\n    return g(x);\n  }\n};\n}\nint A::h(int y) {\n  return 1;\n}\n",
        "csharp": "using System;\nnamespace N {\n  public class A : B, I {\n    public int Run(int x) {\n      return Help(x);\n    }\n  }\n}\n",
    }
    got = {lang: list(patterns.symbols(f"d/f.{lang}", t, lang)) for lang, t in texts.items()}
    kinds = {lang: {(r[2], r[3]) for r in rows if r[0] == "symbol"} for lang, rows in got.items()}
    edges = {lang: {(r[1].split("::", 2)[-1], r[2], r[3]) for r in rows if r[0] == "edge"} for lang, rows in got.items()}
    assert kinds["java"] == {("A", "class"), ("K", "constant"), ("run", "method"), ("I", "interface")}
    assert {("A", "B", "inheritance"), ("A", "I", "implementation"), ("A", "J", "implementation"), ("A.run", "helper", "calls"), ("A.run", "D", "creates"), ("A", "A.run", "defines")} <= edges["java"]
    assert next(r for r in got["java"] if r[2] == "A")[4:6] == (4, 9)
    assert kinds["typescript"] == {("A", "class"), ("run", "method"), ("I", "interface"), ("f", "function"), ("T", "type_alias")}
    assert ("A.run", "move", "calls") in edges["typescript"] and ("f", "./x", "imports") in {(e[0][-1:], *e[1:]) for e in edges["typescript"]}
    assert kinds["go"] == {("S", "struct"), ("Run", "method"), ("main", "function"), ("I", "interface")} and ("S", "S.Run", "defines") in edges["go"]
    assert kinds["rust"] == {("S", "struct"), ("run", "method"), ("T", "trait"), ("main", "function"), ("m", "macro")} and ("S", "T", "implementation") in edges["rust"]
    assert {("A", "class"), ("M", "macro"), ("n", "namespace"), ("f", "method"), ("h", "method")} <= kinds["cpp"] and ("n.A", "B", "inheritance") in edges["cpp"]
    assert {("A", "class"), ("Run", "method")} <= kinds["csharp"] and {("N.A", "B", "inheritance"), ("N.A", "I", "inheritance")} <= edges["csharp"]
    assert [x[0] for x in patterns.code_chunks("f.go", texts["go"], "go")] == ["S", "Run", "main", "I"]


def test_parsed_files_of_several_languages(spark, tmp_path):
    from graphloom.sources import code, patterns

    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.go").write_text("func main() {\n  run()\n}\n")
    (tmp_path / "src" / "big.go").write_text("x" * 5000)
    (tmp_path / "node_modules" / "b.js").write_text("function no() {}")
    (tmp_path / "Makefile").write_text("all:\n")
    found = code.files(spark, str(tmp_path), 4000)
    assert {(r.rel_path, r.language, r.skipped) for r in found.collect()} == {("src/a.go", "go", False), ("src/big.go", "go", True), ("Makefile", "build_config", False)}
    items = patterns.parsed(found)
    assert {(r.id, r.kind) for r in items.where("item = 'symbol'").collect()} == {("go::a::main", "function")}
    assert code.files(spark, str(tmp_path), allowed=(".go",)).count() == 2


def small_tools(spark):
    from graphloom.operators.tools import GraphTools

    n = nodes_of(spark, node("s", "UserService", "class", "src/user.py", text="class UserService: handles login\nline two", doc="Handles users."), node("r", "UserRepo", "class", "src/repo.py"), node("f", "login", path="src/user.py", text="def login"), node("g", "guide", "module_doc", "docs/guide.md", "markdown", text="how to login with UserService"), node("x", "Lonely", "class", "src/x.py")).withColumn("macro_cluster", F.lit(1))
    e = edges_of(spark, ("s", "r", "composition"), ("f", "s", "calls"))
    index = fts.build(n, "node_id", fts.symbol_columns(n))
    vec = spark.createDataFrame([("s", [0.0, 1.0]), ("g", [0.0, 0.9]), ("r", [5.0, 0.0])], "node_id string, embedding array<double>")
    return GraphTools(spark, n, e, index, vec)


def test_tools(spark):
    t = small_tools(spark)
    ids = lambda df: [r.node_id for r in df.collect()]
    assert ids(t.search_symbols("login", 5))[:1] == ["f"] and ids(t.search_symbols("login", symbol_type="class")) == ["s"]
    assert set(ids(t.search_codebase("login", 5, [0.0, 1.0]))) >= {"f", "s", "g"}
    assert {(r.node_id, r.origin) for r in t.search_repository("login", 2).collect()} >= {("f", "hit"), ("s", "neighbour")} or ids(t.search_repository("login", 2))
    assert {(r.source_id, r.target_id) for r in t.relationships("UserService").collect()} == {("s", "r"), ("f", "s")}
    assert {(r.node_id, r.direction, r.other) for r in t.search_graph("UserService", 1).collect()} == {("s", "out", "r"), ("s", "in", "f")}
    assert t.get_code("userservice", 1).first().code == "class UserService: handles login" and ids(t.get_code("serv")) == ["s"]
    assert ids(t.search_docs("login")) == ["g"] and ids(t.search_docs("", embedding=[0.0, 1.0])) == ["g"]
    assert ids(t.query_graph("type:class text:login")) == ["s"]
    page = {r.node_id: r.stage for r in t.page(["UserService"], 1).collect()}
    assert page == {"s": 0, "f": 2, "r": 2, "g": 3}
    assert {r.node_id for r in t.page(["UserService"], 1, budget=14).collect()} >= {"s"}


def test_graph_summaries_and_paths(spark):
    from graphloom.operators import tools as T

    n = spark.createDataFrame([(x,) for x in "abcdz"], "node_id string")
    e = edges_of(spark, ("a", "b", "x"), ("b", "d", "x"), ("a", "c", "x"), ("c", "d", "x"))
    r = T.graph_summary(n, e).first()
    assert (r.nodes, r.edges, r.connected, r.components, r.largest, r.max_degree, r.min_degree) == (5, 4, False, 2, 4, 2, 0) and r.density == pytest.approx(4 / 20)
    assert T.shortest_path(e, "a", "d") == ["a", "b", "d"] and T.shortest_path(e, "d", "a") is None and T.shortest_path(e, "a", "a") == ["a"]
    assert T.degree_centrality(n, e, 1).first().centrality == pytest.approx(2 / 4)
    left = spark.createDataFrame([("a", 1, "l"), ("b", 2, "l")], "node_id string, v int, w string")
    right = spark.createDataFrame([("b", None, "r"), ("c", 3, "r")], "node_id string, v int, w string")
    both, edges = T.merged_graphs((left, e), (right, e.limit(1)))
    assert {tuple(r) for r in both.collect()} == {("a", 1, "l"), ("b", 2, "r"), ("c", 3, "r")} and edges.count() == 5


def test_fusion_of_lists(spark):
    from graphloom.operators import tools as T

    rows = lambda *xs: spark.createDataFrame([(i, s, r) for r, (i, s) in enumerate(xs, 1)], "node_id string, symbol_name string, rank int")
    got = T.fused({"fts": rows(("1", "Foo"), ("2", "Bar")), "vec": rows(("3", "bar"), ("4", None))}).collect()
    assert [(r.key, r.node_id, r.sources) for r in got] == [("bar", "3", "fts,vec"), ("foo", "1", "fts"), ("4", "4", "vec")]
    assert got[0].score == round(1 / 61 + 1 / 62, 6)
    assert [r.node_id for r in T.fused_by_id(rows(("a", "")), rows(("b", ""))).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        T.fused_by_id(rows(("a", "")), k=0)


def test_similar_names_and_analyses(spark):
    from graphloom.operators import tools as T

    names = spark.createDataFrame([(x,) for x in ("GmailWrapper", "GmailClient", "Other", "gmailapiwrapper")], "name string")
    got = [(r.name, r.score) for r in T.similar_names("GmailApiWrapper", names).collect()]
    assert [n for n, _ in got] == ["GmailClient", "GmailWrapper"] and got[0][1] == pytest.approx(0.5)
    assert T.parsed_json('x ```json\n{"capabilities": []}\n``` y', "capabilities") == {"capabilities": []} and T.parsed_json("# text") is None and T.parsed_json('so {"a": 1} it is') == {"a": 1}
    caps = spark.createDataFrame([(0, "Auth login", "users sign in", ["Login", "token"], ["a.py", "b.py"]), (1, "Search", "find users", ["query"], ["b.py", "c.py"]), (2, "None", "", None, ["z.py"])], "place int, name string, description string, keywords array<string>, files array<string>")
    assert [(r.name, r.score) for r in T.matching_capabilities(caps, "How do users login?").collect()] == [("Auth login", 6), ("Search", 1)]
    assert [r.file for r in T.files_for(caps, "How do users login?").collect()] == ["a.py", "b.py", "c.py"]


def test_copies_of_vectors_rank_by_id(spark):
    """Equal vectors are at distance 0 and tie, whatever place they are read at."""
    from graphloom.operators import orphans as O

    rows = [(f"v{i:02}", [0.1, 0.7, 1000.3]) for i in reversed(range(20))] + [("w", [0.1, 0.7, 1000.3000001])]
    v = spark.createDataFrame(rows, "node_id string, embedding array<double>").coalesce(1)
    found = O.nearest_vectors(v.where("node_id = 'v07'").withColumnRenamed("node_id", "orphan"), v, 3).orderBy("rank").collect()
    assert [(r.node_id, r.distance) for r in found] == [("v00", 0.0), ("v01", 0.0), ("v02", 0.0)]


def test_a_name_is_looked_for_once_however_many_orphans_have_it(spark):
    from graphloom.operators import fts
    from graphloom.operators import orphans as O

    texts = [("a", "red bolt"), ("b", "bolt red bolt"), ("c", "red red bolt"), ("d", "blue")]
    index = fts.build(spark.createDataFrame(texts, "node_id string, text string"), "node_id", {"text": F.col("text")})
    names = spark.createDataFrame([(f"o{i}", "Red Bolt") for i in range(50)] + [("x", "red red"), ("y", "none red"), ("z", None)], "orphan string, query string")
    hits = O.name_hits(index, names, 2)
    got = {}
    for r in hits.collect():
        got.setdefault(r.orphan, []).append((r["rank"], r.node_id, r.df))
    assert set(got) == {*(f"o{i}" for i in range(50)), "x"}
    assert all(sorted(got[f"o{i}"]) == [(1, "a", 3), (2, "b", 3)] for i in range(50)) and got["x"] == [(1, "c", 1)]


def test_members_of_groups_are_linked_without_pairs_of_parents(spark):
    rng, langs = random.Random(6), ("python", "java", "go")
    parents = {f"c{i:02d}": rng.randrange(3) for i in range(20)}
    members = [(f"m{i:02d}", f"x.{rng.choice('ab')}", rng.choice(list(parents)), rng.choice(langs)) for i in range(40)]
    last = {(p, name[2:]): (m, lang) for m, name, p, lang in members}  # the largest id of a parent's name
    want = {(a, b) for ((p, x), (a, la)), ((q, y), (b, lb)) in itertools.product(last.items(), last.items()) if p < q and parents[p] == parents[q] and x == y and la != lb}
    n = nodes_of(spark, *[node(m, name=name, kind="method", parent=p, lang=lang) for m, name, p, lang in members])
    groups = spark.createDataFrame(list(parents.items()), "node_id string, number int")
    got = L.member_links_of_groups(n, groups, 0.7).collect()
    assert {(r.source_id, r.target_id) for r in got} == want and len(got) == len(want) > 5
    assert {(r.rel_type, round(r.weight, 9)) for r in got} == {("cross_language_L3", 0.42)}


def test_settled_names_are_not_asked_on(spark, monkeypatch):
    """Names found by tiers 1 to 3 are not joined with all nodes of their name; the others still find tier 5."""
    seen = []
    monkeypatch.setattr(V, "written", lambda df, name: seen.append({(r.name, r.tier) for r in df.collect()}) or df)
    n = nodes_of(spark, *[node(f"n{i}", name="same", path=f"src/{i % 2}.py", lang="go" if i == 4 else "python") for i in range(6)])
    n = n.withColumn("full_name", F.when(F.col("node_id") == "n5", "pkg.other").otherwise(F.col("symbol_name")))
    n = n.withColumn("symbol_name", F.when(F.col("node_id") == "n5", "late").otherwise(F.col("symbol_name")))
    asked = spark.createDataFrame([("same", "src/1.py", "python"), ("same", "", "go"), ("late", "", ""), ("other", "", ""), ("none", "", "")], "name string, file string, language string")
    got = {(r.name, r.lang): (r.node_id, r.tier) for r in V.resolved(asked, n).collect()}
    assert got == {("same", "python"): ("n1", 1), ("same", "go"): ("n0", 3), ("late", ""): ("n5", 5), ("other", ""): ("n5", 4), ("none", ""): (None, None)}
    assert seen == [{("same", 1), ("same", 3), ("late", None), ("other", None), ("none", None)}]


def test_a_name_is_looked_for_once_however_many_nodes_have_it(spark, monkeypatch):
    asked = []
    real = O.name_hits
    monkeypatch.setattr(O, "name_hits", lambda index, names, *rest: asked.append(names.count()) or real(index, names, *rest))
    n = nodes_of(spark, *[node(f"c{i}", name="Widget", kind="class") for i in range(4)], *[node(f"d{i}", text="a Widget here" + " and more" * i) for i in range(5)])
    index = fts.build(n, "node_id", fts.symbol_columns(n))
    got = {(r.source_id, r.target_id) for r in X.framework_references(n.where("symbol_type = 'class'"), n, index).collect()}
    assert asked == [1] and got == {(f"c{i}", f"d{j}") for i in range(4) for j in range(3)}


def test_nodes_of_a_name_take_no_place_of_texts_that_refer_to_it(spark):
    n = nodes_of(spark, *[node(f"c{i:03}", name="Widget", kind="class") for i in range(90)], *[node(f"d{i}", text="a Widget here" + " and more" * i) for i in range(5)])
    index = fts.build(n, "node_id", fts.symbol_columns(n))
    got = {(r.source_id, r.target_id) for r in X.framework_references(n.where("symbol_type = 'class'"), n, index).collect()}
    assert got == {(f"c{i:03}", f"d{j}") for i in range(90) for j in range(3)}


def test_surfaces_meet_in_slices_and_links_come_once(spark, monkeypatch):
    """Tiny slices, nodes with several surfaces, members of parents that share one: as by brute force, each link once."""
    monkeypatch.setattr(L, "PAIRS_AT_ONCE", 8)
    rng, langs = random.Random(3), ("python", "java", "go")
    of = {f"c{i:02d}": rng.choice(langs) for i in range(18)}
    shown = {(c, s): 0.6 + 0.1 * rng.randrange(2) for c in of for s in rng.sample(["x", "y", "z"], rng.randrange(1, 3))}
    members = {f"m{i:02d}": (rng.choice("ab"), rng.choice(list(of)), rng.choice(langs)) for i in range(40)}
    n = nodes_of(spark, *[node(c, path="src/a.py", lang=x) for c, x in of.items()], *[node(m, name=x, kind="method", parent=p, lang=lang) for m, (x, p, lang) in members.items()])
    size = {s: sum(t == s for _, t in shown) for s in "xyz"}
    want = {}
    for (a, s), (b, t) in itertools.product(shown, shown):
        if s == t and a < b and of[a] != of[b]:
            w = max(0.3, min(0.8, 0.7 * (shown[a, s] + shown[b, t]) / 2 / math.log(1 + size[s])))
            want[a, b, "cross_language_L1"] = max(w, want.get((a, b, "cross_language_L1"), 0))
    last = {(p, x): (m, lang) for m, (x, p, lang) in members.items()}
    for (a, b, _), w in list(want.items()):
        for x in "ab":
            if (a, x) in last and (b, x) in last and last[a, x][1] != last[b, x][1]:
                want[last[a, x][0], last[b, x][0], "cross_language_L3"] = max(0.3, 0.6 * w)
    surfaces = spark.createDataFrame([(c, "rest", s, h) for (c, s), h in shown.items()], "node_id string, kind string, surface string, hint double")
    none = spark.createDataFrame([], "source_id string, target_id string, confidence double, score double")
    got = L.cross_language(n, none, surfaces, none).collect()
    assert len(got) == len(want) and {k[2] for k in want} == {"cross_language_L1", "cross_language_L3"}
    assert {(r.source_id, r.target_id, r.rel_type): round(r.weight, 9) for r in got} == {k: round(w, 9) for k, w in want.items()}


def test_pages_of_a_section_too_large_for_a_task(spark, monkeypatch):
    """By rounds, and communities in tasks or by rounds again: every node once, pages within their sizes, groups kept together."""
    rng, rows, links = random.Random(4), [], []
    for g in range(3):
        own = [f"g{g}_{i:02d}" for i in range(20)]
        rows += [node(v, path=f"src/{g}.py", line=i) for i, v in enumerate(own)]
        links += [(a, b, "calls") for a, b in itertools.combinations(own, 2) if rng.random() < 0.7]
    links += [("g0_00", "g1_00", "calls"), ("t0", "t1", "calls"), ("t0", "g2_03", "calls")]
    rows += [node("t0", path="src/2.py"), node("t1", path="src/2.py"), *[node(f"z{i:02d}", path="src/z.py", line=i) for i in range(25)]]
    star, clique = [f"s{i:02d}" for i in range(31)], [f"k{i:02d}" for i in range(26)]
    rows += [node(v, path=f"src/{v[0]}.py", line=i) for vs in (star, clique) for i, v in enumerate(vs)]
    links += [("s00", v, "calls") for v in star[1:]] + [(a, b, "calls") for a, b in itertools.combinations(clique, 2)]
    n, e = nodes_of(spark, *rows), edges_of(spark, *links)
    section = n.select("node_id", F.lit(5).alias("cluster"))
    tasks = []
    real = C._split_in_tasks
    monkeypatch.setattr(C, "_split_in_tasks", lambda *a: tasks.append(1) or real(*a))
    monkeypatch.setattr(C, "SEQUENTIAL_PAIRS", 100)
    found = C.pages(n, e, section, least=4, most=22).collect()
    assert tasks and len(found) == len(rows) and {r.node_id for r in found} == {r[0] for r in rows} and {r.section for r in found} == {5}
    of = {}
    for r in found:
        of.setdefault(r.page, set()).add(r.node_id)
    assert all(len(p) <= 22 for p in of.values()) and sorted(of) == list(range(len(of)))
    for g in range(3):
        assert any({f"g{g}_{i:02d}" for i in range(20)} <= p for p in of.values())
    page = {r.node_id: r.page for r in found}
    assert page["t0"] == page["t1"] == page["g2_03"]
    shares = lambda x: sorted(len([v for v in p if v[0] == x]) for p in of.values() if any(v[0] == x for v in p))
    assert shares("z") == [3, 22] and sum(shares("s")) == 31
    pairs = [(a, b, 1.0) for a, b in itertools.combinations(clique, 2)]
    assert shares("k") == sorted(map(len, C.split(clique, pairs, {v: ("src/k.py", i) for i, v in enumerate(clique)}, 22)))


def test_sections_of_a_large_file_graph_need_no_rounds(spark, monkeypatch):
    """Two dense groups of files and a lone file; beyond the size for names the graph goes by numbers, in one task."""
    monkeypatch.setattr(C, "SEQUENTIAL_PAIRS", 1)
    monkeypatch.setattr(C, "leiden", lambda *a: pytest.fail("rounds"))
    files = [f"{d}/{i}.py" for d in ("src/b", "src/a") for i in range(6)]
    n = nodes_of(spark, *[node(p, path=p) for p in files], node("lone", path="src/a/lone.py"))
    e = edges_of(spark, *[(a, b, "calls") for a, b in itertools.permutations(files, 2) if a[:5] == b[:5]], (files[0], files[6], "calls"))
    got = {r.node_id: r.cluster for r in C.sections(n, e).collect()}
    assert got == {**{p: 0 if p.startswith("src/a") else 1 for p in files}, "lone": 0}


def test_communities_of_a_section_are_split_in_tasks_of_their_own(spark, monkeypatch):
    """The pages are those of the sequential form."""
    asked, real = [], C._split_in_tasks
    monkeypatch.setattr(C, "_split_in_tasks", lambda rows, *a: asked.append(rows.select("section", "group").distinct().count()) or real(rows, *a))
    rng = random.Random(8)
    names = [f"v{i:03}" for i in range(150)]
    pairs = sorted({tuple(sorted(rng.sample(names[k : k + 50], 2))) for k in (0, 50, 100) for _ in range(150)})
    n, e = nodes_of(spark, *[node(v, path=f"src/{i % 3}.py", line=i) for i, v in enumerate(names)]), edges_of(spark, *[(a, b, "calls") for a, b in pairs])
    got = {r.node_id: r.page for r in C.pages(n, e, n.select("node_id", F.lit(2).alias("cluster")), least=4, most=10).collect()}
    links, clusters = [(a, b, 1.0) for a, b in pairs], {}
    found = X.louvain(iter(links))
    for v in names:
        clusters.setdefault(found.get(v, -1), []).append(v)
    assert got == C.sized(clusters, links, {v: (f"src/{i % 3}.py", i) for i, v in enumerate(names)}, 4, 10) and len(asked) == 1 and asked[0] > 2


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_stemmed_postings_are_written_once_and_only_changed_stems_are_looked_up(spark, monkeypatch, broadcast):
    seen, real = [], fts.written
    monkeypatch.setattr(fts, "BROADCAST_STEMS", broadcast, raising=False)
    monkeypatch.setattr(fts, "written", lambda df, name: seen.append((name, df.count())) or real(df, name))
    rows = spark.createDataFrame([("a", "run runs bolt running"), ("b", "bolts bolt run"), ("c", None)], "node_id string, text string")
    index = fts.build(rows, "node_id", {"text": F.col("text")}, stemmed=True)
    got = {(r.term, r.node_id): r.positions for r in index.postings.collect()}
    assert got == {("run", "a"): [0, 1, 3], ("bolt", "a"): [2], ("bolt", "b"): [0, 1], ("run", "b"): [2]}
    assert [x for x in seen if x[0] in ("terms", "stems", "postings")] == [("terms", 10), ("stems", 3), ("postings", 4)]


def test_vectors_are_searched_for_orphans_with_a_hit_of_the_text_alone(spark, monkeypatch):
    """Only hits of both lists reach the threshold, so the others need no search."""
    asked, real = [], O.nearest_vectors
    monkeypatch.setattr(O, "nearest_vectors", lambda q, *a: asked.extend(r.orphan for r in q.collect()) or real(q, *a))
    n = nodes_of(spark, node("a", name="Widget", path="src/x/a.py"), node("b", name="other", path="src/x/b.py", text="a Widget"), node("c", name="lone", path="src/y/c.py"), node("d", name="far", path="src/y/d.py"))
    index = fts.build(n, "node_id", fts.symbol_columns(n))
    v = spark.createDataFrame([(x, [float(i), 0.0]) for i, x in enumerate("abcd")], "node_id string, embedding array<double>")
    got = [(r.source_id, r.target_id, round(r.score, 9)) for r in O.hybrid(n, n, index, v).collect()]
    assert asked == ["a"] and got == [("a", "b", round(2 / 61, 9))]
