import random
import zlib

import numpy as np
import pytest

from graphloom.llm import token_files as tf
from graphloom.llm.token_counts import token_counts
from graphloom.llm.tokens import Encoder, vocabulary_path

SCHEMA = "doc_id long, text string"
TEXTS = ["", "  a  b\n\n c  ", "don't I'VE ''s 'sa \"'s they'll  ", "x<|endoftext|>y <|startoftext|>", "ΣΑΣ İstanbul 東京", " a\u0085b\x1cc", "123 4567 ½²³ªº", "a" * 5000, "é é ÀÈ é", "…—“q” €5  x", "ŉ ǅ ß ẞ", None, "word " * 50_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    of, rng = Encoder(vocabulary_path(name)), random.Random(2)
    letters = "ab'sS td\n\t 1½ªº_-., éßİǅ|<>ŉ’€\x0b\x1f\x85\xa0 "
    fuzz = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(4000)]
    for text in [t for t in TEXTS if t is not None] + fuzz:
        assert list(of.ids(text)) == of.whole(text), repr(text)


def test_token_counts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (3, "b c")]
    got = token_counts(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", n_tokens int"), vocabulary_path("word_bpe_49k.json"))
    of = Encoder(vocabulary_path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        n = len(of.whole(t or ""))
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert token_counts(spark.createDataFrame([], SCHEMA), vocabulary_path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, monkeypatch):
    rows = [(5 * len(TEXTS) - i, t) for i, t in enumerate(TEXTS)] + [(7, "seven"), (7, "seven"), (None, "none")]
    got = sorted((tuple(r) for r in tf.token_files(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", start int")).collect()), key=lambda r: r[1])
    of = Encoder(vocabulary_path("byte_bpe_50k.json"))
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*of.whole(t or ""), 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert tf.token_files(spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_access():
    rng = np.random.default_rng(1)
    for high in (200, 70_000, 2**32):
        ids = np.concatenate([rng.integers(0, high, 5000), [high - 1, 0, 255, 256]]).astype(np.uint32)
        data = tf.encoded(ids, [1, None], np.array([0, 10, len(ids)]))
        file = tf.TokenFile.checked(data)
        assert (file.ids() == ids).all() and file.documents()[0] == [1, None]
        assert [file.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist() and file.token(len(ids) - 1) == 256
    with pytest.raises(ValueError):
        tf.TokenFile.checked(data[:90] + bytes([data[90] ^ 1]) + data[91:])
    empty = tf.TokenFile.checked(tf.encoded(np.zeros(0, np.uint32), [], np.array([0])))
    assert len(empty.ids()) == 0
