"""Every stage of the corpus pipeline, and the whole, against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from graphloom.llm import decontaminate as D
from graphloom.llm.tokens import Encoder, vocabulary_path

from test_ngram_join import brute
from test_quality_mix_toxicity import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, Size int, component_id int, edits int"


def documents():
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(500)]
    item = " ".join(rng.choices(vocab, k=30))
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(vocab, k=rng.randint(20, 80)))
        if i % 10 == 3:
            text = rows[-1][1]  # an exact copy
        elif i % 10 == 4:
            text = " ".join([*rows[-1][1].split()[:-1], "changed"])  # a near one
        elif i % 10 == 6:
            text = f"{text} {item} {text.split()[0]}"
        elif i % 10 == 8:
            text = "$$$ ### || && " * 5
        rows.append((i, text, "en", ["a", "b", None][i % 3]))
    rows += [(200, None, "en", "a"), (201, "", None, "a"), (202, " \n ", "en", "b"), (203, rows[0][1], "en", "b"), (203, rows[0][1], "en", "b"), (None, rows[1][1], "en", "a"), (204, " ".join(rng.choices(vocab, k=60_000)), "de", "b")]
    return [(*r, len(r[1] or ""), "x", 1, 2, 3) for r in rows], [(1, item), (2, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs, items = documents()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], int("#" not in r[1]), 0) for r in docs[:120]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def multiset(rows):
    return Counter(map(str, rows))


def test_quality_drops_only_what_it_must(spark, tables):
    folder, docs = tables
    got = P.keep_good(spark, spark.createDataFrame(docs, SCHEMA), folder)
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    bad = lambda r: plain(r[1])[0] < 10 or 100 * plain(r[1])[4] > 20 * plain(r[1])[0] or "#" in r[1]
    assert multiset(rows_of(got)) == multiset(r for r in docs if not bad(r))


def test_one_document_of_each_class_stays(spark, tables):
    folder, docs = tables
    got = rows_of(P.keep_first(spark, spark.createDataFrame(docs, SCHEMA), folder))
    label = brute([(r[0], r[1]) for r in docs if r[0] is not None])
    want = {i for i, (_, c, _) in label.items() if c == i}
    assert Counter(r[0] for r in got if r[0] is not None) == Counter(want)
    assert sum(r[0] is None for r in got) == 1 and multiset(got) <= multiset(docs)


def test_documents_with_items_go(spark, tables):
    folder, docs = tables
    item = documents()[1][0][1]
    got = rows_of(P.keep_unleaked(spark, spark.createDataFrame(docs, SCHEMA), folder))
    words = D._text_words(item)
    bad = {r[0] for r in docs if D.edit_distance_within(words, D._text_words(r[1] or "")) <= int(D.TAU * len(words))} - {None}
    assert bad and multiset(got) == multiset(r for r in docs if r[0] not in bad)


def test_mix_repeats_whole_documents(spark, tables):
    folder, docs = tables
    got = multiset(rows_of(P.mix(spark, spark.createDataFrame(docs, SCHEMA), folder)))
    assert got == multiset(rows_of(P.mix(spark, spark.createDataFrame(docs[::-1], SCHEMA).repartition(5), folder)))
    given = multiset(docs)
    assert all(n <= 3 * given[r] for r, n in got.items())
    size = lambda r: len((r[1] or "").split())
    total = sum(map(size, docs))
    own = Counter()
    for r in docs:
        own[r[3]] += size(r)
    taken = Counter()
    for r in docs:
        taken[r[3]] += size(r) * got[str(r)] // given[str(r)]
    weights = {"a": 5, "b": 2, None: 1}
    capped, target = set(), {}
    while True:
        left, weight = total - sum(3 * own[s] for s in capped), sum(w for s, w in weights.items() if s not in capped)
        target = {s: 3 * own[s] if s in capped else left * w / weight for s, w in weights.items()}
        more = {s for s in weights if target[s] > 3 * own[s]}
        if not more:
            break
        capped |= more
    longest = {s: max(size(r) for r in docs if r[3] == s) for s in weights}
    assert all(abs(taken[s] - target[s]) <= 3 * longest[s] for s in weights)


def tokens_of(docs):
    of = Encoder(vocabulary_path("byte_bpe_50k.json"))
    out, at = [], 0
    for i, text in sorted(((r[0], r[1]) for r in docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*of.whole(text or ""), 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_run(spark, tables):
    folder, docs = tables
    stage_by_stage = spark.createDataFrame(docs, SCHEMA)
    for _, stage in P.STAGES[:-1]:
        stage_by_stage = spark.createDataFrame(stage(spark, stage_by_stage, folder).collect(), SCHEMA)
    want = tokens_of(rows_of(stage_by_stage))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want and want


def test_empty(spark, tables):
    folder, _ = tables
    for _, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0
