import random

import numpy as np

from graphloom.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def edited(rng, words, n, vocab):
    out = list(words)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = rng.choice(vocab)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice(vocab))
    return out


def brute(docs, items):
    hashed = {i: D._text_words(t) for i, t in docs}
    out = {}
    for k, t in items:
        w = D._text_words(t or "")
        for i, words in hashed.items():
            if len(w) >= D.SHORT_WORDS and (d := D.edit_distance_within(w, words)) <= int(D.TAU * len(w)):
                out[i, k] = d
    return out


def test_recall_and_exactness(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(12, 60)))) for k in range(40)]
    docs = []
    for i in range(400):
        w = rng.choices(vocab, k=rng.randint(0, 200))
        if i % 2:
            item = rng.choice(items)[1].split()
            at = rng.randint(0, len(w))
            w[at:at] = edited(rng, item, rng.randint(0, int(D.TAU * len(item))), vocab)
        docs.append((i, " ".join(w).title() if i % 3 else " ".join(w)))
    expected = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.edits for r in D.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert all(expected[k] == v for k, v in got.items())
    assert len(expected) >= 200 and len(got) >= 0.97 * len(expected), (len(got), len(expected))


def placed(rng, words, part, vocab):
    """The words with a fifth of them edited, all edits within a part of the item."""
    n = len(words)
    lo, hi = {"head": (0, 0.2), "front": (0, 0.4), "middle": (0.3, 0.7), "tail": (0.8, 1), "everywhere": (0, 1)}[part]
    at = rng.sample(range(int(lo * n), max(int(hi * n), int(lo * n) + int(D.TAU * n))), int(D.TAU * n))
    kind = rng.choice(["replace", "cut", "insert"])
    if not at:
        return list(words)
    return [x for i, w in enumerate(words) for x in ([w] if i not in at else {"replace": [rng.choice(vocab)], "cut": [], "insert": [rng.choice(vocab), w]}[kind])]


def test_no_leak_is_lost_wherever_the_edits_are(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    items = [(n * 10 + k, " ".join(rng.choices(vocab, k=n))) for n in (5, 7, 9, 10, 15, 30, 60, 100, 150, 240, 300) for k in range(2)]
    docs = []
    for part in ("head", "front", "middle", "tail", "everywhere"):
        for _, text in items:
            for _ in range(2):
                around = rng.choices(vocab, k=40)
                docs.append((len(docs), " ".join(around[:20] + placed(rng, text.split(), part, vocab) + around[20:])))
    expected = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.edits for r in D.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(expected) >= len(docs) and got == expected, (len(got), len(expected))


def test_no_leak_is_lost_at_a_wider_tau():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(50)]
    item = rng.choices(vocab, k=12)
    bench = D.Benchmark([(1, " ".join(item))], 0.4)
    words = D._text_words(" ".join(["x", *(f"y{i}" if i % 3 == 0 else w for i, w in enumerate(item)), "z"]))
    assert bench.unnarrowed and bench.found_in(words, np.zeros(len(words), np.uint64), np.zeros(len(words), bool)) == {0: 4}


def test_edges(spark):
    item = " ".join(f"a{i}" for i in range(20))
    items = [(1, item), (2, item), (3, ""), (4, None), (5, "short item here"), (None, item)]
    docs = [(1, "x " + item.upper()), (1, "x " + item.upper()), (2, None), (3, ""), (4, "a SHORT item here too"), (None, item), (5, "z " * 200_000 + item)]
    got = D.leaks(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", item_id int"), spark.createDataFrame(items, ITEMS)).collect()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in got), key=key) == sorted([(1, 1, 0), (1, 2, 0), (1, 1, 0), (1, 2, 0), (4, 5, 0), (None, 1, 0), (None, 2, 0), (5, 1, 0), (5, 2, 0)], key=key)
    assert D.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert D.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_edit_distance():
    words = lambda t: np.array([ord(c) for c in t], np.uint64)
    assert D.edit_distance_within(words("kitten"), words("xxsittingxx")) == 2
    assert D.edit_distance_within(words("abc"), words("")) == 3
