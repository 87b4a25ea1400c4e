import random
import re
from collections import Counter

import numpy as np

import pyarrow as pa

from graphloom.llm import ngram_join
from graphloom.llm import textcore as tc
from graphloom.llm.ngram_join import _dealt, _planes, _prefix, _runs, frequent_shingles, ngram_jaccard_join

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    degree = Counter(x for pair in links for x in pair)
    return {i: (len(sets[i]), label[i], degree[i]) for i in sets}


def found(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocab, k=30))
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(3, 90))
        for _ in range(rng.choice([1, 1, 3, 9])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(" ".join(own) + (" " + passage if rng.random() < 0.3 else ""))
    rows += [rows[0], rows[0].upper(), "", " \t\n", None, "one two", "One  two", "x y z v", passage]
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_members_of_one_group_that_do_not_link(spark):
    """Equal sizes and prefixes, different rests: one group, of which only some members link."""
    frequent = frequent_shingles(spark.createDataFrame([], SCHEMA))
    known = " ".join(f"k{i}" for i in range(40))
    rng = random.Random(1)

    def prefix(text):
        (_, s), *_ = tc.shingle_sets(pa.array([text]))
        return len(s), tuple(_prefix(s, frequent, np.zeros(0, np.int64)).tolist())

    rows, by_prefix = [], {}
    for i in range(4000):  # a few words of one text replaced, until several texts share size and prefix
        words = known.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(40)] = f"r{rng.randrange(10**6)}"
        by_prefix.setdefault(prefix(" ".join(words)), []).append(" ".join(words))
    groups = [texts for texts in by_prefix.values() if len(texts) > 1]
    assert groups
    rows = list(enumerate(t for texts in groups for t in texts))[:300]
    want = brute(rows)
    assert found(spark, rows) == want
    first = {t: texts[0] for texts in groups for t in texts}
    alone = [i for i, t in rows if want[i][2] < sum(first[u] == first[t] for _, u in rows) - 1]
    assert alone  # some member does not link with all others of its group


def test_count_of_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = f"u{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    assert found(spark, rows) == brute(rows)


def test_links_that_no_centre_has(spark):
    # a chain: neighbours link, the ends do not
    words = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(12)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {c for _, c, _ in got.values()} == {0}


def test_edges(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 6), (None, "a b c d e f", 7), (2, "A B C D E F", None), (3, None, 1)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA + ", n int")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_very_long_text(spark):
    text = "ab cd " * 300_000
    got = ngram_jaccard_join(spark.createDataFrame([(1, text), (2, text + "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 2, 1), (2, 3, 2)]


def test_runs_of_equal_codes_are_alike(spark):
    # whichever of them is kept, and however often the plan is computed, the name and the members are the same
    shared = np.sort(tc.mix(np.arange(1, 41, dtype=np.uint64))) >> np.uint64(16)
    frequent = shared[:1] << np.uint64(16)
    heads = spark.createDataFrame([(rep, 160, _planes(shared, 6), 0) for rep in range(6)], "rep long, n int, head binary, several int").repartition(3)
    rows = _runs(_dealt(heads, 8, frequent), frequent).where("kind = 1").collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.code, set()).add((r.token, frozenset(r.members)))
    assert all(len(x) == 1 for x in seen.values())
    hot = [r for r in rows if r.token == int(shared[0])]
    assert {m for r in hot for m in r.members} == set(range(6))
    assert len({r.token for r in rows}) == 2 and len(rows) > len(hot)
