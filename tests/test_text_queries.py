"""Stems, query texts, NEAR groups: against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.stems import stem, without_marks
from graphloom.operators import fts


def _is_consonant(w, i):
    return w[i] not in "aeiou" and not (w[i] == "y" and i and _is_consonant(w, i - 1))


def _measure(w):
    kinds = "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))
    return "".join(k for k, _ in itertools.groupby(kinds)).count("vc")


def _vowel(w):
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _short(w):
    return len(w) > 2 and _is_consonant(w, len(w) - 1) and not _is_consonant(w, len(w) - 2) and _is_consonant(w, len(w) - 3) and w[-1] not in "wxy"


def porter(w):
    """Porter's rules letter by letter."""
    if not 3 <= len(w) <= 63 or not "a" <= w[-1] <= "z":
        return w
    w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w.removesuffix("s")
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for e in ("ed", "ing"):
            if w.endswith(e):
                if _vowel(w[: -len(e)]):
                    w = w[: -len(e)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bcdfghjkmnpqrtvwxy":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    second = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
    third = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for rules in (second, third):
        found = max((r.split(":") for r in rules.split() if w.endswith(r.split(":")[0])), key=lambda r: len(r[0]), default=None)
        if found and _measure(w[: -len(found[0])]):
            w = w[: -len(found[0])] + found[1]
    e = max((x for x in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split() if w.endswith(x)), key=len, default="")
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)][-1:] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: Words and stems that the paper gives.
GIVEN = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat sized:size hopping:hop falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic vietnamization:vietnam operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil"


def test_stems(spark, sf_dir):
    rng = random.Random(7)
    ends = "s es ed ing y ies eed ational tional izer ation ness ful ement ment ion ll e ous ive ize logy bility ss".split()
    made = {"".join(rng.choice("bcdlstvwxyaeiou") for _ in range(rng.randint(1, 6))) + "".join(rng.choices(ends, k=rng.randint(0, 3))) for _ in range(8_000)}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).distinct()
    words = made | {r.w for r in texts.limit(5_000).collect()} | {"", "a", "is", "yes", "yyy", "y", "ééé", "naïves", "1ing", "x" * 64 + "s", "agreed9"} | {g.split(":")[0] for g in GIVEN.split()}
    got = dict(spark.createDataFrame([(w,) for w in words], "w string").repartition(8).select("w", stem("w")).collect())
    assert {w: s for w, s in got.items() if s != porter(w)} == {}
    assert [g for g in GIVEN.split() if got[g.split(":")[0]] != g.split(":")[1]] == []


def test_marks(spark):
    assert spark.createDataFrame([("Éàøñßüçřệ x",)], "t string").select(without_marks(F.col("t"))).first()[0] == "Eaønßucre x"


COLUMNS = ("name", "body")
P, N, M = fts.Phrase, fts.Near, fts.Match
READ = {
    "one Two": M("and", (P(("one",)), P(("two",)))),
    "a OR b AND c NOT d e": M("or", (P(("a",)), M("and", (P(("b",)), M("not", (P(("c",)), M("and", (P(("d",)), P(("e",)))))))))),
    '(a OR "b c"*) AND d + e': M("and", (M("or", (P(("a",)), P(("b", "c"), True))), P(("d", "e")))),
    "name : x* -name : y {body name}: ^z": M("and", (P(("x",), True, ("name",)), P(("y",), False, ("body",)), P(("z",), False, ("name", "body"), True))),
    "body : (a AND name : b)": M("and", (P(("a",), False, ("body",)), P(("b",), False, ()))),
    "NEAR(a b c, 3) d": M("and", (N((P(("a",)), P(("b",)), P(("c",))), 3), P(("d",)))),
    'NEAR("a b" c*)': N((P(("a", "b")), P(("c",), True)), 10),
    "near(a)": None,
    '"it""s" - x': None,
    "snake_case": P(("snake", "case")),
    '"..." a': P(("a",)),
    "a NOT": None,
    "AND": None,
    "un:known": None,
    "(a) b": None,
    "a AND (b": None,
    "": None,
}


@pytest.mark.parametrize("text", list(READ))
def test_query_texts(text):
    assert fts.parsed(text, COLUMNS) == READ[text]


def test_a_text_that_ends_too_early_is_a_prefix():
    assert fts.parsed("conn", COLUMNS) == P(("conn",)) and fts.parsed('say "conn', COLUMNS) is None
    assert fts.parsed("a +", COLUMNS) is None


def _rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "connected", "connection", "of"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words, weights=[3, 3, 2, 1, 1, 1, 1, 9], k=rng.randint(0, 40)))) for i in range(150)]


def _find(row, leaf):
    """Starts of a phrase, or closing places of a group's clumps, in each column."""
    out = {}
    for c, text in zip(COLUMNS, row[1:], strict=True):
        t = text.split()
        if leaf.column is not None and c not in leaf.column:
            continue
        if isinstance(leaf, P):
            ok = lambda x, w, last: x.startswith(w) if last and leaf.prefix else x == w  # noqa: B023, E731
            n = len(leaf.words)
            out[c] = [i for i in range(len(t) - n + 1) if all(ok(t[i + j], w, j == n - 1) for j, w in enumerate(leaf.words)) and (i == 0 or not leaf.first)]
        else:
            starts = [(i, j, i + len(p.words) - 1) for j, p in enumerate(leaf.phrases) for i in _find((0, *(text,) * 2), P(p.words, p.prefix, None, p.first))[c]]
            out[c] = []
            for s in starts:
                before = [max((e for a, k, e in starts if k == j and (a, k) <= s[:2]), default=None) for j in range(len(leaf.phrases))]
                if None not in before and s[0] - min(before) - 1 <= leaf.distance:
                    out[c].append(s[0])
    return out


def _matches(row, q):
    if isinstance(q, M):
        parts = [_matches(row, p) for p in q.parts]
        return parts[0] and not parts[1] if q.op == "not" else all(parts) if q.op == "and" else any(parts)
    return any(_find(row, q).values())


@pytest.mark.parametrize("text", ["alpha beta", "alpha OR delta NOT beta", "(alpha OR delta) AND beta", "alph*", "name : alpha", "-name : alpha + beta", "^gamma", "NEAR(alpha delta, 2)", "NEAR(alpha beta gamma delta, 4)", 'NEAR("alpha beta" gam*, 3) NOT name : of', "NEAR(alpha alpha, 5)", "{name body} : (delta AND gamma)", "nothing"])
def test_matches_by_brute_force(spark, text):
    rows = _rows()
    index = fts.build(spark.createDataFrame(rows, "id long, name string, body string").repartition(3), "id", {c: F.col(c) for c in COLUMNS})
    query = fts.parsed(text, COLUMNS)
    got = {r.id: r.score for r in fts.search(index, query, {"name": 4.0}, None).collect()}
    want = {r[0] for r in rows if _matches(r, query)}
    assert set(got) == want and (want or text in ("nothing", "NEAR(alpha alpha, 5)") or pytest.fail("finds nothing"))
    import math

    leaf_rows = {p: {r[0]: sum((4.0 if c == "name" else 1.0) * len(x) for c, x in _find(r, p).items()) for r in rows} for p in fts.leaves(query)}
    length = {r[0]: len(r[1].split()) + len(r[2].split()) for r in rows}
    mean = sum(length.values()) / len(rows)
    for i in want:
        score = 0.0
        for p in fts.leaves(query):
            df = sum(f > 0 for f in leaf_rows[p].values())
            f = leaf_rows[p][i]
            score += max(1e-6, math.log((len(rows) - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / mean)) if f else 0.0
        assert got[i] == pytest.approx(score)


def test_stemmed_index(spark):
    rows = [(1, "Connecting the Dots", ""), (2, "connections", "relational"), (3, "disconnect", "relate"), (4, None, "Naïve connected connectors"), (5, None, None)]
    index = fts.build(spark.createDataFrame(rows, "id long, name string, body string"), "id", {c: F.col(c) for c in COLUMNS}, fts.folded_tokens, True)
    ask = lambda text: sorted(r.id for r in fts.search(index, fts.stemmed_query(spark, fts.parsed(text, COLUMNS)), k=None).collect())
    assert ask("connection") == [1, 2, 4] and ask("connected NOT dotted") == [2, 4] and ask("relating") == [2, 3]
    assert ask("naivety") == [] and ask("naïve") == [4] and ask("connec*") == [1, 2, 4] and ask("connecting*") == []
    assert ask("NEAR(dot connects, 1)") == [1] and ask('"naive connection"') == [4] and ask("") == []


# ---- JQL by routes --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def routed(spark, sf_dir):
    from graphloom.operators import routes
    from graphloom.plans.code_view import code_edges, code_nodes

    nodes, edges = code_nodes(spark, sf_dir), code_edges(spark, sf_dir)
    return routes.build(nodes, edges, fts.build(nodes, "node_id", fts.symbol_columns(nodes))), nodes, edges


@pytest.mark.parametrize("jql, kind", [
    ("name:smallgizmo30", "name"), ("name:Small* type:class", "name"), ("type:class file:src/small", None), ("file:src/*/b2* layer:public_api", "file"), ("type:!=class layer:entry_point", "scan"),
    ("connections:>5 limit:500", "scan"), ("type:struct has_rel:calls dir:out", "type"), ("name:RedBolt* related:SmallGizmo30", "name"), ("type:cl* name:!=x limit:300", "type"), ("name:*bolt* limit:200", "scan"), ("type:nothing", "type"), ("type:enum OR name:Big*", None),
])
def test_routes_give_what_a_scan_gives(spark, routed, jql, kind):
    from graphloom.operators import routes
    from graphloom.plans.jql import compile_jql

    tables, nodes, edges = routed
    assert [tuple(r) for r in routes.answer(tables, jql).collect()] == [tuple(r) for r in compile_jql(jql, nodes, edges).collect()]
    if kind:
        assert [r.kind for r in routes.explained(tables, jql)] == [kind]


def test_the_narrowest_route_is_read(spark, routed):
    from graphloom.operators import routes
    from graphloom.plans import jql as J

    tables, nodes, _ = routed
    one = nodes.where("symbol_type = 'class'").orderBy("node_id").first()
    route, rows = routes.routed(tables, J.parse(f"type:class name:{one.symbol_name} text:every").alternatives[0])
    assert route.kind == "name" and route.rows < nodes.where("symbol_type = 'class'").count()
    assert "EqualTo(name," in rows._jdf.queryExecution().executedPlan().toString()  # the files' statistics skip the rest
    assert "PartitionFilters: [isnotnull(kind" in routes.routed(tables, J.parse("type:class").alternatives[0])[1]._jdf.queryExecution().executedPlan().toString()
    route, rows = routes.routed(tables, J.parse('text:"apache license" type:text_chunk').alternatives[0])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert route.kind == "text" and "Filter (isnotnull(node_id" in plan and "Join" not in plan  # ids as literals


def test_many_ids_are_joined(spark, routed, monkeypatch):
    from graphloom.operators import routes

    want = [tuple(r) for r in routes.answer(routed[0], "text:every type:class limit:50").collect()]
    monkeypatch.setattr(routes, "LITERAL_IDS", 1)
    assert want and [tuple(r) for r in routes.answer(routed[0], "text:every type:class limit:50").collect()] == want


def test_an_index_is_made_anew_when_any_table_changes(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/b.parquet")
    made = []
    ask = lambda: fts.kept(spark, "t", [f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"], lambda: made.append(1) or len(made))
    assert ask() == 1 and ask() == 1
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/b.parquet")  # a new file in a folder
    assert ask() == 2 and ask() == 2


def test_equal_parts_tie_whatever_order_they_come_in(spark):
    parts = [(q, p) for q, p in enumerate((0.1, 0.2, 0.3))]
    rows = [("a", *x) for x in parts] + [("b", *x) for x in reversed(parts)] + [("c", *parts[i]) for i in (1, 2, 0)]
    found = {r.id: r for r in fts.summed(spark.createDataFrame(rows, "id string, q int, part double").coalesce(1), "id").collect()}
    assert {r.score for r in found.values()} == {0.1 + 0.2 + 0.3}
    assert all(r.qs == [0, 1, 2] for r in found.values())


def test_packed_postings_keep_places_and_lengths(spark):
    rows = [(1, "red bolt red", "red"), (2, "", ""), (3, None, "bolt Red bolt")]
    index = fts.build(spark.createDataFrame(rows, "id long, name string, body string"), "id", {c: F.col(c) for c in ("name", "body")})
    got = {(r.term, r.id, r.col): list(r.positions) for r in index.postings.collect()}
    assert got == {("red", 1, "name"): [0, 2], ("bolt", 1, "name"): [1], ("red", 1, "body"): [0], ("bolt", 3, "body"): [0, 2], ("red", 3, "body"): [1]}
    assert {r.id: r.dl for r in index.lengths.collect()} == {1: 4, 2: 0, 3: 3}
