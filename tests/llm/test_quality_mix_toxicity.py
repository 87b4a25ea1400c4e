import re
import time
from collections import Counter

import numpy as np

from graphloom.llm.mixing import mixed
from graphloom.llm.quality import fit_quality, quality_rules
from graphloom.llm.toxicity import fit_toxicity, maximal_segments, toxicity

DOCS = "doc_id long, text string, source string"


def plain(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark):
    good = [(i, f"the cat number {i} sat on a mat and then it went home to sleep {i * 7} times", "a") for i in range(40)]
    junk = [(100 + i, f"$$$ ### {i} || && %% $$ ## ** ## $$ {i} ||| &&& %%%", "a") for i in range(40)]
    odd = [(200, None, None), (201, "", "a"), (202, " \n\t\n", "a"), (203, "é ñ\n\né ñ\né ñ \n", "a"), (204, "a b c d e " * 30, "a"), (204, "a b c d e " * 30, "a"), (None, "x\x0by z", "a"), (205, "long word " * 100_000, "a")]
    docs = spark.createDataFrame([(*r, 3) for r in good + junk + odd], DOCS + ", n_words int")
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in junk] + [(999, 1), (None, 0), (1, None)], "doc_id long, quality int")
    rows = quality_rules(docs, fit_quality(docs, labels)).collect()
    texts = [r[1] for r in good + junk + odd]
    got = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter(map(plain, texts))
    kept = {r.doc_id for r in rows if r.kept}
    assert {r[0] for r in good} <= kept and not kept & {r[0] for r in junk} and 204 not in kept
    nothing = fit_quality(docs, labels.limit(0))
    assert {r.kept == (not r.base_failed) for r in quality_rules(docs, nothing).collect()} == {True}
    assert quality_rules(docs.limit(0), nothing).count() == 0


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 50), ["a", "b", "c", None][min(3, i % 7)]) for i in range(2000)] + [(5, None, "a"), (None, "x y", "a"), (1, "q", "d"), (1, "q", "d"), (9, "", "empty")]
    out = mixed(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", rank int")).collect()
    assert len(out) == len(rows)
    total = sum(r.size for r in out)
    targets = {r.source: (r.target, r.source_size) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    for source, (target, size) in targets.items():
        own = [r for r in out if r.source == source]
        assert target <= 3 * size + 1e-9 and all(0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 60, source
    again = mixed(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", rank int").repartition(7)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixed(spark.createDataFrame([], DOCS)).count() == 0


def _best_segments(values):
    """By definition: the best contiguous run, then the best ones left and right of it."""
    if not values:
        return []
    sums = np.concatenate([[0], np.cumsum(values)])
    score, i, j = max((sums[j] - sums[i], i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1))
    if score <= 0:
        return []
    return [*_best_segments(values[:i]), (i, j, score), *((a + j, b + j, x) for a, b, x in _best_segments(values[j:]))]


def test_segments_by_definition():
    rng = np.random.default_rng(8)
    for _ in range(150):
        n = int(rng.integers(1, 40))
        values, there = rng.normal(0.0, 2.0, n), rng.random(n) < 0.6
        full = np.where(there, values, -0.3)
        got = maximal_segments(np.flatnonzero(there), values[there], 0.3)
        want = _best_segments(full.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_segments_take_linear_time():
    for pattern in ([1.0, -2.0], [1.0, -0.999], [1.0, -0.5, -0.51], [3.0, -1.0, 1.0, -3.1]):
        took = []
        for n in (20_000, 80_000):
            values = np.resize(np.array(pattern), n)
            began = time.process_time()
            maximal_segments(np.arange(n), values, 0.0)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.2, (pattern, took)


def test_segments():
    got = maximal_segments(np.array([0, 1, 3, 20, 21]), np.array([4.0, -5.0, 3.0, 2.0, 2.0]), 0.5)
    assert got == [(0, 1, 4.0), (3, 4, 3.0), (20, 22, 4.0)]
    assert maximal_segments(np.array([0, 2]), np.array([3.0, 3.0]), 0.5) == [(0, 3, 5.5)]


def test_toxicity(spark):
    import random

    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = rng.choices(vocab, k=rng.randint(20, 200))
        if toxic := i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["vile", "scumbag", "nasty"]) for _ in range(4)]
        docs.append((i, " ".join(w), "a"))
        labels.append((i, int(toxic)))
    docs += [(1000, None, "a"), (1001, "", "a"), (None, "vile nasty vile scumbag", "a")]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], DOCS + ", score double")
    truth = dict(labels)
    rows = toxicity(frame, fit_toxicity(frame, spark.createDataFrame([*labels, (5000, 1), (None, 1), (1, None)], "doc_id long, toxic int"))).collect()
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth)
    assert right >= 0.95 * len(truth) and len(rows) == len(docs)
    texts = {d[0]: d[1] for d in docs}
    assert all(texts[r.doc_id][p.start : p.end].split()[0] in ("vile", "scumbag", "nasty") for r in rows if r.doc_id in truth for p in r.passages)
    none = toxicity(frame, fit_toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert all(r.score < 0.5 for r in none)
