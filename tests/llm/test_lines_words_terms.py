"""Line dedup, spelling variants and source divergence against brute force on small awkward tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from graphloom.llm.divergence import OP13_SQL, op13_source_divergence, share, source_divergence
from graphloom.llm.line_dedup import OP12_SQL, drop_repeated_lines, op12_line_dedup
from graphloom.llm.spelling import OP11_SQL, near_pairs, op11_spelling_variants, parity_mask, run_counts, spelling_forms

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _plain(frame):
    return sorted(tuple("" if pd.isna(v) else str(int(v) if isinstance(v, float) else v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("query, sql", [(op11_spelling_variants, OP11_SQL), (op12_line_dedup, OP12_SQL), (op13_source_divergence, OP13_SQL)])
def test_queries_match_sql(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 100 and _plain(got) == _plain(want)


# ---- lines ----------------------------------------------------------------------------------------------------

SHARED = "A line of text that many documents share"
LONG = "\n".join([SHARED, *(f"line number {i} of a long text" for i in range(30_000)), SHARED.upper()])
DOCS = [
    (1, f"{SHARED}\nown words one", "en", "a", 1),
    (2, f"  {SHARED.upper()}\t\nshort\nshort", "en", "a", 1),
    (3, f"x\n\n{SHARED}\n{SHARED}\n", None, "b", None),
    (4, None, "en", None, 0),
    (5, "", "en", "a", 0),
    (6, "É wide line that two documents have\nshort", "fr", "a", 1),
    (7, "é wide line that two documents have\nshort", "fr", "a", 1),  # É is not A-Z
    (8, "short\r\n\x0b " + SHARED + " \r", "fr", "a", 1),
    (8, SHARED, "fr", "a", 1),  # a doc_id again
    (8, SHARED, "fr", "a", 1),  # and the row again
    (None, f"{SHARED}\nkept", "fr", "a", 1),
    (None, f"{SHARED}\nkept too", "fr", "a", 1),
    (0, LONG, "en", "c", 1),
    (9, "nineteen characters\nnineteen characters", "en", "c", 1),
    (10, "nineteen characters", "en", "c", 1),
    (11, "nineteen characters", "en", "c", 1),
]


def _lines_by_hand(rows, least=20, docs=3):
    key = lambda line: _lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < docs or doc == max((d for d in held[key(x)] if d is not None), default=None)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_lines_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr("graphloom.llm.line_dedup.HOT_SHARE", hot)  # with 1, no key is hot
    got = drop_repeated_lines(spark.createDataFrame(DOCS, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == _lines_by_hand(DOCS)


def test_every_line_hot(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.line_dedup.HOT_SHARE", 10**9)
    got = drop_repeated_lines(spark.createDataFrame(DOCS, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == _lines_by_hand(DOCS)


def test_lines_edges(spark):
    none = drop_repeated_lines(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    clash = spark.createDataFrame([(i, SHARED, 7, 8) for i in range(3)], "doc_id long, text string, n_lines int, row int")
    got = drop_repeated_lines(clash, carry=("n_lines", "row"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "_n_lines", "row"]
    assert sorted(map(tuple, got.collect())) == [(0, "", 1, 1, 7, 8), (1, "", 1, 1, 7, 8), (2, SHARED, 1, 0, 7, 8)]


def test_op12_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_line_dedup(spark, str(tmp_path))
    assert [f"{n} {t}" for n, t in got.dtypes] == ["doc_id bigint", "n_lines bigint", "n_dropped bigint", "kept_sha256 string"]
    want = sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in _lines_by_hand(DOCS)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


# ---- words ----------------------------------------------------------------------------------------------------


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _forms_by_hand(n):
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], form[w], n[form[w]] if form[w] else None, len(near[w]), root))
    return sorted(rows, key=str)


def _mutations(words):
    """Every kind of edit at every place of a few words, and edits of edits."""
    out = Counter()
    for j, w in enumerate(words):
        out[w] += 10_000
        for i in range(len(w) + 1):
            out[w[:i] + "é" + w[i:]] += 5 + i
            out[w[:i] + "z" + w[i + 1 :]] += 300 + i
            out[w[:i] + w[i + 1 :]] += 7
            out[w[:i] + "zq" + w[i + 2 :]] += 20
    return {w: n for w, n in out.items() if w}


def test_near_words_by_brute_force(spark):
    words = _mutations(["connection", "connexion", "aaaaaa", "abcabcabc", "straße", "éééééé"])
    words |= {"a": 5, "b": 30, "ab": 3, "𝄞music": 4, "music": 100, "x" * 5_000: 9, "x" * 5_001: 50}
    got = spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    rows = sorted(map(tuple, got.select("word", "n", "form", "form_n", "n_near", "root").collect()), key=str)
    assert rows == _forms_by_hand(words)


def test_each_pair_once_and_masks(spark):
    words = _mutations(["spelling", "spellings"])
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs)) == sum(_near(a, b) for a in words for b in words if a < b)
    masks = dict(spark.createDataFrame([(w,) for w in words] + [("",)], "word string").select("word", parity_mask("word")).collect())
    assert masks[""] == 0 and max(bin(masks[a] ^ masks[b]).count("1") for a, b in pairs) == 2


def test_chains_ties_and_edges(spark):
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125, "cccccc": 10, "cccccd": 50, "bccccc": 50}
    got = {r["word"]: (r["form"], r["root"]) for r in spelling_forms(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert got["aaaaaa"] == ("aaaaab", "bbbbbb") and got["bbbbbb"] == (None, "bbbbbb") and got["cccccc"] == ("bccccc", "bccccc")
    twice = spark.createDataFrame([("letter", 3, "x"), ("letter", 3, "y"), (None, 9, "z"), ("lettre", None, "z"), ("letters", 1, "z")], "word string, n long, form string")
    assert sorted(map(tuple, spelling_forms(twice).select("word", "n", "form").collect())) == [("letter", 6, None), ("letters", 1, "letter")]
    assert spelling_forms(spark.createDataFrame([], "word string, n long")).count() == 0


def test_runs_by_brute_force(spark, tmp_path):
    texts = [" ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}é, ÉTÉété×÷ABCdef_ghijkl{i % 3}" for i in range(900)), "été" * 5_000, None, "", "short tiny", "naïveté NAÏVETÉ naÏveté " * 9]
    rows = [(i % 40 if i % 7 else None, texts[i % len(texts)], "en", "a", 1) for i in range(90)]
    want = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 6
    want = {w: n for w, n in want.items() if n >= 5}
    docs = spark.createDataFrame(rows, SCHEMA)
    assert dict(run_counts(docs).collect()) == want and any(len(w) == 7 for w in want)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_spelling_variants(spark, str(tmp_path))
    assert [f"{n} {t}" for n, t in got.dtypes] == ["word string", "form string", "root string", "n bigint", "n_near bigint", "form_n bigint"]
    assert sorted(map(tuple, got.select("word", "n", "form", "form_n", "n_near", "root").collect()), key=str) == _forms_by_hand(want)


# ---- terms ----------------------------------------------------------------------------------------------------


def _divergence_by_hand(rows, least=30):
    docs = [(lang or "", source or "", [_lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, _ in rows]
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    shares, of_lang = {}, {}
    for lang in held:
        kept = sorted(t for t, d in held[lang].items() if d >= least)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        own = {s: c for (x, s), c in groups.items() if x == lang}
        shares |= {(lang, s): p(c) for s, c in own.items()}
        of_lang[lang] = p(sum(own.values(), Counter()))
    for (lang, source), p in shares.items():
        pairs = [(-sum(abs(p[t] - q[t]) for t in p), s.encode()) for (x, s), q in shares.items() if x == lang and s != source]
        terms = [(of_lang[lang][t] - p[t], t.encode()) for t in p if groups[lang, source][t] and p[t] > of_lang[lang][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def _mixed_docs():
    rows = []
    for i in range(400):
        lang, source = [("en", "a"), ("en", "b"), ("en", None), (None, "a"), ("fr", "c"), ("fr", "d"), ("xx", "lone"), ("xx", "other")][i % 8 if i < 390 else 6 + i % 2]
        words = " ".join(f"W{chr(97 + (i * j) % 17)}é{'Z' * (j % 3)}" for j in range(i % 60))
        rows.append((i, [words + " Ünd_und9und[x]", None, "", "12 34"][0 if i % 11 else 1 + i % 3] if lang != "xx" else "seldom", lang, source, 1))
    return rows + [(5, "same same SAME Wbé", "en", "a", 1)] * 40


def test_divergence_by_brute_force(spark):
    rows = _mixed_docs()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, source_divergence(docs).collect()))
    assert got == _divergence_by_hand(rows) and {r[2] for r in got} == {"pair", "term"}
    high = source_divergence(docs, min_docs=10_000).collect()  # nothing kept: all values are 0, ties by bytes
    assert high and {r["value"] for r in high} == {0} and {r["part"] for r in high} == {"pair"}


def test_divergence_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.divergence.BROADCAST_GROUPS", 0)
    rows = _mixed_docs()
    assert sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA)).collect())) == _divergence_by_hand(rows)


def test_divergence_edges(spark):
    empty = source_divergence(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and [f"{n} {t}" for n, t in empty.dtypes] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    clash = spark.createDataFrame([("a b", "en", "s", 1, 2, 3)], "text string, lang string, source string, term int, n int, docs int")
    assert source_divergence(clash, min_docs=1).count() == 0  # one source is its language
    for count, total, kept in [(0, 1, 1), (9_223_372_035, 10**15, 7), (9_223_372_030, 10**10, 3), (10**17, 10**18, 10**9)]:
        got = spark.sql(f"SELECT {count}L AS c, {total}L AS t, {kept}L AS v").select(share("c", "t", "v")).first()[0]
        assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)


def test_keys_of_words_are_not_broadcast(spark):
    from graphloom.llm import spelling

    words = spark.createDataFrame([("kettle", 50), ("kettl", 5), ("kettles", 7)], "word string, n long")
    pairs = spelling.near_pairs(words)
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in pairs.collect()} == {("kettl", "kettle"), ("kettle", "kettles")}
