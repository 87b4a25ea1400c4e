"""Public tokenizers in Python workers: exact ids through a cache of pre-tokens.

A BPE tokenizer splits a text into pre-tokens and encodes each on its own, so the ids of a text are the ids of
its pre-tokens in order.  Here pre-tokens are cut as the tokenizer's own pattern cuts them, by array operations on
the bytes of many texts at once, and each distinct one is encoded by the tokenizers library once per worker.  Texts
for which cutting here might differ from the library (special strings, or characters outside the ranges below, whose
classes depend on a Unicode version) go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm import textcore as tc
from graphloom.llm.textcore import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Characters whose classes, case and composition are settled (Latin up to U+024F, general punctuation,
# currency), by code point: the first and last of each range.
_SETTLED = [(0x0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC)]
_LETTERS = [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)]
_NUMBERS = [(0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE)]
_SPACES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0)]
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSETTLED = range(5)
#: Between pre-tokens that are encoded together: a character that no settled text holds.
_BETWEEN = "\ue000".encode()
#: A capital whose small form has two characters.
_DOTTED = "\u0130"
#: Pre-tokens that a worker keeps.
CACHE_SIZE = 200_000


def _classes() -> np.ndarray:
    out = np.full(0x2100, _UNSETTLED, np.uint8)
    for ranges, kind in ((_SETTLED, _OTHER), (_LETTERS, _LETTER), (_NUMBERS, _NUMBER), (_SPACES, _SPACE)):
        for lo, hi in ranges:
            out[lo : hi + 1] = kind
    return out


_CLASS = _classes()


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _CLASS[np.minimum(data, 0x7F)]
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        lead = wide[data[wide] >= 0xC0]
        two, three = lead[data[lead] < 0xE0], lead[(data[lead] >= 0xE0) & (data[lead] < 0xF0)]
        point = ((data[two].astype(np.int32) & 0x1F) << 6) | (data[two + 1] & 0x3F)
        out[two] = out[two + 1] = _CLASS[point]
        point = ((data[three].astype(np.int32) & 0xF) << 12) | ((data[three + 1].astype(np.int32) & 0x3F) << 6) | (data[three + 2] & 0x3F)
        out[three] = out[three + 1] = out[three + 2] = np.where(point < len(_CLASS), _CLASS[np.minimum(point, len(_CLASS) - 1)], _UNSETTLED)
        four = lead[data[lead] >= 0xF0]
        for k in range(4):
            out[four + k] = _UNSETTLED
    return out


def _contractions(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For quotes that start a run, the small letters after them that belong to a contraction: 0, 1 or 2.  ``ends`` bound their texts."""
    letter = lambda k: np.where(at + k < ends, data[np.minimum(at + k, len(data) - 1)], 0)
    a, b = letter(1), letter(2)
    out = np.zeros(len(at), np.int64)
    for pair in ("re", "ve", "ll"):
        out[(a == ord(pair[0])) & (b == ord(pair[1]))] = 2
    for one in "stmd":
        out[a == ord(one)] = 1
    return out


def cut(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the pre-tokens of consecutive texts, and for each text whether it is settled.

    ``words``: numbers are cut into characters, and white space is dropped; otherwise a space joins what follows it,
    and white space but its last character is a pre-token.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(offsets) - 1, bool)
    kind = _byte_classes(data)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    head = np.ones(n, bool)
    head[1:] = (kind[1:] != kind[:-1]) | row_start[1:n]
    if words:
        head |= (kind == _NUMBER) & ((data & 0xC0) != 0x80)
    start = np.flatnonzero(head)
    end = np.append(start[1:], n)
    sort = kind[start]
    row = np.searchsorted(offsets, start, "right") - 1
    settled = np.ones(len(offsets) - 1, bool)
    settled[row[sort == _UNSETTLED]] = False
    begins, stops = start.copy(), end.copy()
    quote = (sort == _OTHER) & (end - start == 1) & (data[start] == 39)
    if words:
        keep = sort != _SPACE
    else:
        keep = np.ones(len(start), bool)
        follows = np.zeros(len(start), bool)  # a run of the same text comes after
        follows[:-1] = row[1:] == row[:-1]
        blank = (sort == _SPACE) & follows
        last = data[end - 1]
        # where the last character of the white space starts: it may have two bytes
        tail = end - 1 - ((last & 0xC0) == 0x80)
        joins = blank & (last == 32)
        after = np.flatnonzero(joins) + 1
        begins[after] -= 1
        quote[after] = False
        stops[joins] = end[joins] - 1
        keep[joins & (stops == start)] = False
        cut_off = np.flatnonzero(blank & ~joins & (tail > start))
        stops[cut_off] = tail[cut_off]
        extra = (tail[cut_off], end[cut_off])
    which = np.flatnonzero(quote)
    if len(which):
        more = _contractions(data, start[which], offsets[row[which] + 1])
        which, more = which[more > 0], more[more > 0]
        stops[which] += more
        begins[which + 1] += more  # the letters' run, which may end here
        keep[which + 1] &= begins[which + 1] < stops[which + 1]
    begins, stops = begins[keep], stops[keep]
    if not words and len(extra[0]):
        order = np.argsort(np.concatenate([begins, extra[0]]), kind="stable")
        begins, stops = np.concatenate([begins, extra[0]])[order], np.concatenate([stops, extra[1]])[order]
    return begins, stops, settled


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        self.letters = dict(enumerate(_byte_letters()))
        self.between = "".join(self.letters[b] for b in _BETWEEN)
        self.cache = Cache(self.pieces)
        del spec
        give_back()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of settled pre-tokens, each by the library's model."""
        written = _BETWEEN.join(pieces).decode("latin-1").translate(self.letters)
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(p)] for p in written.split(self.between)] if pieces else []

    def pretokens(self, chunk: tc.Chunk, raw: tc.Chunk | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the pre-tokens of a chunk's settled texts, and which texts those are.

        ``chunk`` holds lowered texts; ``raw`` the same as they were."""
        raw = raw or chunk
        starts, ends, settled = cut(chunk.data, chunk.offsets, self.lower)
        odd = [(raw, special.encode()) for special in self.special] + ([(raw, _DOTTED.encode())] if self.lower else [])
        for of, text in odd:
            part = of.data.tobytes()
            at = part.find(text)
            while at >= 0:  # a find across two texts sends the first to the library, which does no harm
                row = int(np.searchsorted(of.offsets, at, "right")) - 1
                settled[row] = False
                at = part.find(text, int(of.offsets[row + 1]))
        if not settled.all():
            kept = settled[np.searchsorted(chunk.offsets, starts, "right") - 1]
            starts, ends = starts[kept], ends[kept]
        return starts, ends, tc.span_hash(chunk.prefix_hash(), starts, ends), settled

    def chunks(self, texts: pa.Array) -> Iterator[tuple[tc.Chunk, tc.Chunk]]:
        """Chunks of the texts lowered, and as they are."""
        if not self.lower:
            for chunk in tc.chunks(texts):
                yield chunk, chunk
            return
        for raw in tc.chunks(texts):
            part = pa.LargeStringArray.from_buffers(raw.rows, pa.py_buffer(np.ascontiguousarray(raw.offsets)), pa.py_buffer(np.ascontiguousarray(raw.data)))
            low = pc.utf8_lower(part)
            offsets = np.frombuffer(low.buffers()[1], np.int64)[: raw.rows + 1]
            data = np.frombuffer(low.buffers()[2], np.uint8)[: offsets[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
            yield tc.Chunk(raw.first, data, offsets), raw

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, in order; null is empty."""
        for chunk, raw in self.chunks(texts):
            starts, ends, hashes, settled = self.pretokens(chunk, raw)
            got, counts = self.cache.values_of(chunk.data, starts, ends, hashes)
            upto = np.concatenate([[0], np.cumsum(counts)])
            bounds = upto[np.searchsorted(starts, chunk.offsets)]
            for i in range(chunk.rows):
                if settled[i]:
                    yield got[bounds[i] : bounds[i + 1]]
                else:
                    yield np.array(self.whole(raw.data[raw.offsets[i] : raw.offsets[i + 1]].tobytes().decode()), np.uint32)

    def ids(self, text: str) -> np.ndarray:
        return next(self.batch(pa.array([text])))


class Cache:
    """Ids, or what else ``make`` gives for pre-tokens, by hash: a flat array and where each begins.  Full, it starts anew."""

    def __init__(self, make: Callable[[list[bytes]], list[list[int]]], size: int = CACHE_SIZE):
        self.make, self.size = make, size
        self._clear(size)

    def _clear(self, room: int) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(room + 1, np.int64)

    def _add(self, keys: list[int], values: list[list[int]]) -> None:
        k, counts = len(self.place), np.fromiter(map(len, values), np.int64, len(values))
        ends = self.begin[k] + np.cumsum(counts)
        at, end = int(self.begin[k]), int(ends[-1])
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end - len(self.flat)), np.uint32)])
        self.flat[at:end] = np.fromiter(chain.from_iterable(values), np.uint32, end - at)
        self.begin[k + 1 : k + 1 + len(values)] = ends
        self.place.update(zip(keys, range(k, k + len(values)), strict=True))

    def values_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all pre-tokens one after another, and how many each has."""
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(keys) > len(self.begin) - 1 or self.begin[len(self.place)] > 8 * self.size:
            self._clear(max(self.size, len(keys)))
        known = keys.tolist()
        where = np.fromiter(map(self.place.get, known, repeat(-1)), np.int64, len(known))
        missing = np.flatnonzero(where < 0)
        if len(missing):
            raw, k = data.tobytes(), len(self.place)
            spans = zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)
            self._add([known[i] for i in missing.tolist()], self.make([raw[a:b] for a, b in spans]))
            where[missing] = np.arange(k, k + len(missing))
        begin, count = self.begin[where], self.begin[where + 1] - self.begin[where]
        counts = count[inverse]
        total = int(counts.sum())
        shift = begin[inverse] - (np.cumsum(counts) - counts)
        return self.flat[np.repeat(shift, counts) + np.arange(total)], counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
