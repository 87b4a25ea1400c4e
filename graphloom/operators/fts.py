"""Full-text search over an inverted index: postings by term with positions, built once and read by term.

A query is alternatives of phrases, or a tree of AND, OR and NOT over phrases and NEAR groups (``parsed`` makes one of a text).  A
phrase is words that follow each other, the last one perhaps a prefix, perhaps in some columns alone.  Every phrase and group
that occurs counts in the score, but for those that must not occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions.stems import stem, without_marks
from graphloom.operators.search import space_tokens
from graphloom.sources.shared import discard, written

#: Weights of the columns of the symbol index.
SYMBOL_WEIGHTS = {"symbol_name": 10.0, "name_tokens": 8.0, "docstring": 3.0, "content": 1.0}

#: Stems that are broadcast to the postings, at most; more are joined.
BROADCAST_STEMS = 500_000
#: Rows of postings that go back from a task's Python at once.
ROWS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | tuple[str, ...] | None = None
    first: bool = False  # at the beginning of its column

    def __str__(self) -> str:
        quoted = '"' + " ".join(self.words).replace('"', '""') + '"'
        column = "{" + " ".join(self.column) + "}" if isinstance(self.column, tuple) else self.column
        return (f"{column}:" if column else "") + ("^" if self.first else "") + quoted + ("*" if self.prefix else "")


@dataclass(frozen=True)
class Near:
    """Phrases in one column, in any order, with at most ``distance`` tokens between the first one's end and the last one's start."""

    phrases: tuple[Phrase, ...]
    distance: int = 10
    column: str | tuple[str, ...] | None = None


@dataclass(frozen=True)
class Match:
    """``op`` is and, or, not (the first part without the second)."""

    op: str
    parts: tuple


Query = list[list[Phrase]]
Leaf = Phrase | Near


class BadQuery(ValueError):
    pass


_LEXEME = re.compile(r"""\s*(?:"((?:[^"]|"")*)"|([\w\x1a\x80-\U0010FFFF]+)|([(){}:*+^,-]))""")


class _Parser:
    """Query text: words and "phrases", * after a prefix, + between parts of a phrase, ^ before the first words of a column,
    column: or {some columns}: or -column: before a phrase, a group or a parenthesis, NEAR(phrases, distance), NOT, AND, OR (which bind in this
    order, operators in capitals), parentheses.  Phrases side by side must all occur, which binds tightest."""

    def __init__(self, text: str, columns: tuple[str, ...]):
        self.columns, self.at, self.lexemes = columns, 0, []
        text = text.rstrip()
        place = 0
        while place < len(text):
            m = _LEXEME.match(text, place)
            if not m:
                raise BadQuery(f"cannot read {text[place:]!r}")
            quoted, bare, mark = m.groups()
            self.lexemes.append(("phrase", quoted.replace('""', '"')) if quoted is not None else ("word", bare) if bare is not None else ("mark", mark))
            place = m.end()

    def peek(self, *wanted: tuple[str, str]) -> bool:
        return self.at < len(self.lexemes) and self.lexemes[self.at] in wanted

    def take(self, kind: str, value: str | None = None) -> str:
        if self.at >= len(self.lexemes) or self.lexemes[self.at][0] != kind or value not in (None, self.lexemes[self.at][1]):
            raise BadQuery(f"expected {value or kind} at {self.at}")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def whole(self):
        out = self.joined("OR")
        if self.at < len(self.lexemes):
            raise BadQuery(f"more after the end: {self.lexemes[self.at][1]!r}")
        return out

    def joined(self, op: str, among: tuple[str, ...] | None = None):
        below = {"OR": "AND", "AND": "NOT", "NOT": None}[op]
        part = (lambda: self.joined(below, among)) if below else (lambda: self.side_by_side(among))
        out = part()
        while self.peek(("word", op)):
            self.at += 1
            out = _both(op.lower(), out, part())
        return out

    def side_by_side(self, among: tuple[str, ...] | None):
        out, alone = self.item(among)
        while not alone and self.at < len(self.lexemes) and not self.peek(("mark", ")"), ("word", "AND"), ("word", "OR"), ("word", "NOT"), ("mark", "(")):
            more, alone = self.item(among)
            if alone:
                raise BadQuery("a parenthesis needs an operator ahead")
            out = _both("and", out, more)
        if self.peek(("mark", "(")):
            raise BadQuery("a parenthesis needs an operator ahead")
        return out

    def item(self, among: tuple[str, ...] | None):
        """A leaf or what stands in parentheses, and whether it is the latter."""
        own = self.named()
        if own is not None:
            among = own if among is None else tuple(c for c in among if c in own)
        if self.peek(("mark", "(")):
            self.at += 1
            out = self.joined("OR", among)
            self.take("mark", ")")
            return out, True
        if self.peek(("word", "NEAR")) and self.lexemes[self.at + 1 : self.at + 2] == [("mark", "(")]:
            self.at += 2
            phrases, distance = [], 10
            while not self.peek(("mark", ")"), ("mark", ",")):
                phrases.append(self.phrase(None))
            if self.peek(("mark", ",")):
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise BadQuery(f"no distance: {number}")
                distance = int(number)
            self.take("mark", ")")
            kept = tuple(p for p in phrases if p.words)
            one = Phrase(kept[0].words, kept[0].prefix, among, kept[0].first) if len(kept) == 1 else None
            return (one or (Near(kept, distance, among) if kept else None)), False
        own_phrase = self.phrase(among)
        return (own_phrase if own_phrase.words else None), False

    def named(self) -> tuple[str, ...] | None:
        """Columns ahead of a colon, if any."""
        start, minus = self.at, self.peek(("mark", "-"))
        self.at += minus
        if self.peek(("mark", "{")):
            self.at += 1
            names = []
            while not self.peek(("mark", "}")):
                names.append(self.take("word") if self.lexemes[self.at : self.at + 1] and self.lexemes[self.at][0] == "word" else self.take("phrase"))
            self.at += 1
        elif self.at + 1 < len(self.lexemes) and self.lexemes[self.at][0] != "mark" and self.lexemes[self.at + 1] == ("mark", ":"):
            names = [self.lexemes[self.at][1]]
            self.at += 1
        else:
            self.at = start
            return None
        self.take("mark", ":")
        if unknown := [n for n in names if n not in self.columns]:
            raise BadQuery(f"no such column: {unknown[0]}")
        return tuple(c for c in self.columns if (c in names) != minus)

    def phrase(self, among: tuple[str, ...] | None) -> Phrase:
        first = self.peek(("mark", "^"))
        self.at += first
        words: list[str] = []
        while True:
            if self.peek(("word", "AND"), ("word", "OR"), ("word", "NOT")) or self.at >= len(self.lexemes) or self.lexemes[self.at][0] == "mark":
                raise BadQuery(f"expected a phrase at {self.at}")
            words += phrase(self.lexemes[self.at][1]).words
            self.at += 1
            if not self.peek(("mark", "+")):
                break
            self.at += 1
        prefix = self.peek(("mark", "*"))
        self.at += prefix
        return Phrase(tuple(words), prefix, among, first)


def _both(op: str, a, b):
    """Both parts joined; a part without words counts as if it were not there."""
    if a is None or b is None:
        return a if b is None else None if op == "not" else b
    flat = (a.parts if isinstance(a, Match) and a.op == op else (a,)) if op != "not" else (a,)
    return Match(op, (*flat, b))


def parsed(text: str, columns: tuple[str, ...]) -> Match | Leaf | None:
    """The query that a text is; if it cannot be read, the text as a prefix; if that cannot be read either, or has no word, None."""
    for attempt in (text, f"{text}*"):
        try:
            return _Parser(attempt, columns).whole()
        except BadQuery:
            continue
    return None


def leaves(query, scored: bool = True) -> list[Leaf]:
    """The phrases and groups of a query, those that must not occur left out if ``scored``; repeated ones as often as they stand."""
    if isinstance(query, list):
        return [p for group in query for p in group if p.words]
    if isinstance(query, Match):
        parts = query.parts[:1] if scored and query.op == "not" else query.parts
        return [x for p in parts for x in leaves(p, scored)]
    return [] if query is None else [query]


def with_words(query, change):
    """The query with ``change`` made to every whole word (prefixes stay as they are)."""
    if isinstance(query, Match):
        return Match(query.op, tuple(with_words(p, change) for p in query.parts))
    if isinstance(query, Near):
        return Near(tuple(with_words(p, change) for p in query.phrases), query.distance, query.column)
    if isinstance(query, Phrase):
        last = len(query.words) - 1
        return Phrase(tuple(w if query.prefix and i == last else change(w) for i, w in enumerate(query.words)), query.prefix, query.column, query.first)
    return query if query is None else [[with_words(p, change) for p in group] for group in query]


def rendered(query: Query) -> str:
    return " OR ".join(" ".join(map(str, group)) for group in query)


def phrase(text: str, prefix: bool = False, column: str | None = None) -> Phrase:
    """As the tokenizer reads it: words of letters and digits, lower-cased."""
    return Phrase(tuple(re.findall(r"[^\W_]+", text.lower())), prefix, column)


def tokens(text: Column) -> Column:
    """Words of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Words of questions that say nothing about code, and words that do though they might be taken for such.
STOP_WORDS = frozenset(
    """a an the is are was were be been being am do does did has have had having will would shall should may might must can could
    how what when where which who whom why this that these those i me my we us our you your he she it they them its their
    of in to for with on at by from about as into through during before after above below between under over
    get set make work works use uses used find show tell give and or but not no so if then else all each every any some many
    much more most other than very just also only here there out up down""".split()
)
CODE_WORDS = frozenset(
    """class classes function functions method methods interface interfaces struct structs enum enums module modules package packages
    constant constants type types variable variables parameter parameters error errors exception exceptions handler handlers
    service services config configuration factory builder manager client server request response database cache queue stream
    test tests mock fixture auth authentication authorization api rest http grpc async await promise callback abstract virtual
    override static template generic trait mixin create delete update read init initialize setup teardown parse parser serialize
    deserialize validate validation schema import export inherit implement handle process execute run connect disconnect open
    close send receive publish subscribe load save store fetch retrieve""".split()
)


def split_identifier(name: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    return re.sub(r"[^a-zA-Z0-9]", " ", spaced).lower().split()


def keywords(question: str, least: int = 2, identifiers: bool = True) -> list[str]:
    """Words of a question that may name something in code, identifiers also by their parts, in order and once."""
    out: dict[str, None] = {}
    for raw in re.split(r"[^a-zA-Z0-9_]+", question.strip()):
        low = raw.lower()
        if not raw or (low in STOP_WORDS and low not in CODE_WORDS):
            continue
        parts = split_identifier(raw) if identifiers and low not in CODE_WORDS and ("_" in raw or any(c.isupper() for c in raw[1:])) else []
        for w in [low, *(p for p in parts if p not in STOP_WORDS or p in CODE_WORDS)]:
            if len(w) >= least:
                out[w] = None
    return list(out)


def symbol_resolution(name: str) -> Query:
    """A symbol by the beginning of its name, or by the parts of its name: the column holds for the first part alone."""
    name = name.strip()
    if not name:
        return []
    parts = split_identifier(name)
    split = [[Phrase((p,), False, "name_tokens" if i == 0 else None) for i, p in enumerate(parts)]] if len(parts) > 1 else []
    return [[phrase(name, True, "symbol_name")], *split]


def concept(words: list[str], boost_docstring: bool = True) -> Query:
    docs = [[phrase(w, False, "docstring")] for w in words] if boost_docstring else []
    return [[phrase(w, True)] for w in words] + docs


def phrase_query(text: str, column: str | None = None) -> Query:
    return [[phrase(text, False, column)]] if text.strip() else []


def symbols_and_concepts(names: list[str], words: list[str]) -> Query:
    return [group for n in names for group in symbol_resolution(n)] + concept(words)


def prepared(question: str) -> Query:
    """Every word of two letters or more and the parts of identifiers, as prefixes."""
    out: dict[str, None] = {}
    for raw in re.split(r"\W+", question.strip()):
        if len(raw) >= 2:
            out[raw.lower()] = None
            for part in split_identifier(raw):
                if len(part) >= 2:
                    out[part] = None
    return [[phrase(w, True)] for w in out]


def simple(question: str) -> Query:
    return [[phrase(w, True)] for w in re.split(r"\W+", question.strip()) if len(w) >= 2]


def from_question(question: str, intent: str = "general") -> Query:
    """A query for an intent: general, symbol, concept or doc."""
    if intent == "symbol":
        return symbol_resolution(question)
    words = keywords(question)
    if not words:
        return simple(question)
    if intent == "doc":
        return [[p] for w in words for p in (phrase(w, True), phrase(w, False, "docstring"), phrase(w, False, "content"))]
    return concept(words, intent == "concept")


def for_vectors(question: str, context: list[str] | None = None) -> str:
    """The words of a question, and of its context, as a text to embed."""
    out = keywords(question) or [question.strip()]
    for term in context or []:
        if (clean := term.strip().lower()) and clean not in out:
            out.append(clean)
    return " ".join(out)


@dataclass
class Index:
    """postings (term, key, col, positions), lengths (key, dl), and statistics (n, avgdl) of the rows with a token."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    key: str


def _packed(columns: list[str]):
    """A batch of keys and token lists as rows term, key, col, positions; and a row of each key alone with its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = batch.num_rows, batch.column(0)
            total = np.zeros(n, np.int32)
            for at, name in enumerate(columns, 1):
                sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
                total += sizes
                words = batch.column(at).flatten().dictionary_encode()
                if not len(words):
                    continue
                place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                held = np.repeat(np.arange(n), sizes) * len(words.dictionary) + words.indices.to_numpy()
                order = np.argsort(held, kind="stable")
                held = held[order]
                first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
                row, term = np.divmod(held[first], len(words.dictionary))
                positions = pa.ListArray.from_arrays(np.append(first, len(order)).astype(np.int32), pa.array(place[order].astype(np.int32)))
                arrays = [words.dictionary.take(pa.array(term)), keys.take(pa.array(row)), pa.repeat(pa.scalar(name), len(first)), positions]
                for start in range(0, len(first), ROWS_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([a.slice(start, ROWS_AT_ONCE) for a in arrays], names=["term", batch.schema.names[0], "col", "positions"])
            if n:
                none = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([none, keys, none, pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), pa.array(total))], names=["term", batch.schema.names[0], "col", "positions"])

    return run


def build(rows: DataFrame, key: str, columns: dict[str, Column], tokenizer=tokens, stemmed: bool = False) -> Index:
    """Postings sorted by term, so that a reader of some terms skips the rest by the files' statistics.

    A ``stemmed`` index holds the stems of the tokens; what asks it has its words stemmed too (``stemmed_query``).
    """
    own = rows.select(key, *(tokenizer(F.coalesce(c, F.lit(""))).alias(n) for n, c in columns.items()))
    # a text's equal terms are packed where the text is read, so no token is shuffled alone, and texts are cut once
    packed = written(own.mapInArrow(_packed(list(columns)), f"term string, {key} {dict(own.dtypes)[key]}, col string, positions array<int>"), "terms")
    # written before it is ranged: ranges are found by a pass over the rows, which would tokenize all texts again
    terms, made = packed.where("term IS NOT NULL"), [packed]
    if stemmed:  # every term is stemmed once, and only those that change are looked up
        stems = written(terms.select("term").distinct().withColumn("stem", stem("term")).where("stem <> term"), "stems")
        made.append(stems)
        near = F.broadcast(stems) if stems.count() <= BROADCAST_STEMS else stems
        terms = terms.join(near, "term", "left").select(F.coalesce("stem", "term").alias("term"), key, "col", "positions")
    terms = terms.repartitionByRange("term", key)
    if stemmed:  # terms of one stem lie together by the ranges, so their places meet without another shuffle
        terms = terms.groupBy("term", key, "col").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    postings = written(terms.sortWithinPartitions("term", key), "postings")
    lengths = written(packed.where("term IS NULL").select(key, F.col("positions")[0].alias("dl")), "lengths")
    for table in made:
        discard(table)
    return Index(postings, lengths, written(lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "stats"), key)


def symbol_columns(nodes: DataFrame) -> dict[str, Column]:
    return {"symbol_name": F.col("symbol_name"), "name_tokens": S.name_tokens(F.col("symbol_name")), "docstring": F.col("docstring"), "content": F.col("source_text")}


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of every file of a table, whether it is a file or a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def kept(spark: SparkSession, name: str, paths: list[str], make) -> Index:
    """The index of some tables, built once in a session: known by all their files' paths, lengths and times of change."""
    memo = spark.sparkContext.__dict__.setdefault("_graphloom_indexes", {})
    known = (spark.sparkContext.applicationId, name, *(f for p in paths for f in files(spark, p)))
    if known not in memo:
        memo[known] = make()
    return memo[known]


def _matches(term: Column, word: str, prefix: bool) -> Column:
    return term.startswith(word) if prefix else term == word


def stemmed_query(spark: SparkSession, query):
    """The query as a stemmed index holds its words: without marks above letters, stemmed by the rules of the index; a word
    after which more may follow (a prefix) is not stemmed, as in a prefix search it stands for itself."""
    words = sorted({w for leaf in leaves(query, False) for p in (leaf.phrases if isinstance(leaf, Near) else (leaf,)) for w in p.words})
    rows = spark.createDataFrame([(w,) for w in words] or [("",)], "word string").withColumn("plain", without_marks(F.col("word")))
    known = {r.word: r.stem for r in rows.select("word", stem("plain").alias("stem")).collect()}
    return with_words(query, lambda w: known[w])


def folded_tokens(text: Column) -> Column:
    """Words of letters and digits, lower-cased, without marks above or below letters."""
    return tokens(without_marks(F.coalesce(text, F.lit(""))))


def _within(column: str | tuple[str, ...] | None) -> Column:
    return F.lit(True) if column is None else F.col("col").isin(*([column] if isinstance(column, str) else column))


def _placed(own: DataFrame, key: str, phrases: list[Phrase]) -> DataFrame:
    """key, col, and for each phrase the places (s0, s1, ...) where it starts; only postings of its words are read."""
    last = [len(p.words) - 1 for p in phrases]
    matches = [[_matches(F.col("term"), w, p.prefix and i == e) for i, w in enumerate(p.words)] for p, e in zip(phrases, last, strict=True)]
    any_word = reduce(Column.__or__, (m for group in matches for m in group))
    # several terms may begin with a prefix: their places are put in order
    spots = [F.array_sort(F.flatten(F.collect_list(F.when(m, F.col("positions"))))).alias(f"p{j}w{i}") for j, group in enumerate(matches) for i, m in enumerate(group)]
    together = own.where(any_word).groupBy(key, "col").agg(*spots)

    def starts(j: int, p: Phrase) -> Column:
        # places of the words, moved back to the start of the phrase, that are there for every word
        out = F.col(f"p{j}w0")
        for i in range(1, len(p.words)):
            out = F.array_intersect(out, F.expr(f"transform(p{j}w{i}, x -> x - {i})"))
        return F.filter(out, lambda x: x == 0) if p.first else out

    return together.select(key, "col", *(starts(j, p).alias(f"s{j}") for j, p in enumerate(phrases)))


def _clumps(near: Near) -> Column:
    """How many starts of a phrase close a clump: the phrase that ends first, of the latest of each until then, is near enough.

    One pass over the starts in order, with the latest end of every phrase: the smallest window that closes at a place is the
    one of the latest starts, so no other needs to be looked at.
    """
    n = len(near.phrases)
    events = "array_sort(concat(" + ", ".join(f"transform(s{j}, x -> struct(x AS at, {j} AS j, x + {len(p.words) - 1} AS ends))" for j, p in enumerate(near.phrases)) + "))"
    seen = "transform(a.seen, (e, j) -> if(j = v.j, v.ends, e))"
    close = f"named_struct('seen', {seen}, 'n', a.n + if(forall({seen}, e -> e >= 0) AND v.at - array_min({seen}) - 1 <= {near.distance}, 1, 0))"
    return F.expr(f"aggregate({events}, named_struct('seen', array_repeat(-1, {n}), 'n', 0), (a, v) -> {close}, a -> a.n)")


def phrase_hits(index: Index, p: Leaf, weights: dict[str, float]) -> DataFrame:
    """key and f, the column-weighted number of places of a phrase, or of clumps of a group."""
    weight = S.looked_up(F.col("col"), weights, 1.0)
    own = index.postings.where(_within(p.column))
    if isinstance(p, Near):
        found = _placed(own, index.key, list(p.phrases)).select(index.key, (weight * _clumps(p)).alias("f"))
        return found.where("f > 0").groupBy(index.key).agg(F.sum("f").alias("f"))
    if len(p.words) == 1 and not p.first:
        return own.where(_matches(F.col("term"), p.words[0], p.prefix)).groupBy(index.key).agg(F.sum(weight * F.size("positions")).alias("f"))
    return _placed(own, index.key, [p]).select(index.key, (weight * F.size("s0")).alias("f")).where("f > 0").groupBy(index.key).agg(F.sum("f").alias("f"))


def _holds(query, place: dict[Leaf, int]) -> Column:
    """Whether a row that holds the leaves of the array ``qs`` matches."""
    if isinstance(query, list):
        groups = [reduce(Column.__and__, (F.array_contains("qs", place[p]) for p in group if p.words), F.lit(True)) for group in query]
        return reduce(Column.__or__, groups, F.lit(False))
    if isinstance(query, Match):
        parts = [_holds(p, place) for p in query.parts]
        return parts[0] & ~parts[1] if query.op == "not" else reduce(Column.__and__ if query.op == "and" else Column.__or__, parts)
    return F.array_contains("qs", place[query])


def summed(parts: DataFrame, key: str) -> DataFrame:
    """key, score and qs of ``parts(key, q, part)``: parts are added in the order of q.

    The order in which rows come from a shuffle differs from key to key and changes the last bits of a sum, so that equal
    scores would no longer tie.
    """
    own = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("q", "part"))).alias("s"))
    return own.select(key, F.aggregate("s", F.lit(0.0), lambda a, x: a + x["part"]).alias("score"), F.col("s.q").alias("qs"))


def search(index: Index, query: Query | Match | Leaf | None, weights: dict[str, float] | None = None, k: int | None = 10, among: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score (higher is better) of the k best rows that match, of those ``among`` if given: BM25 with weighted columns.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6.  Only postings of the query's terms are read.  Without ``k``, all rows
    that match.
    """
    spark = index.postings.sparkSession
    phrases = list(dict.fromkeys(leaves(query, False)))
    if not phrases:
        return spark.createDataFrame([], f"{index.key} {dict(index.lengths.dtypes)[index.key]}, score double")
    hits = None
    for i, p in enumerate(phrases):
        own = phrase_hits(index, p, weights or {}).select(index.key, F.lit(i).alias("q"), F.col("f").cast("double").alias("f"))
        hits = own if hits is None else hits.union(own)
    scored = leaves(query)
    times = {i: float(scored.count(p)) for i, p in enumerate(phrases)}
    df = hits.groupBy("q").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = S.looked_up(F.col("q"), times) * idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = hits.join(F.broadcast(df), "q").join(index.lengths, index.key).crossJoin(F.broadcast(index.stats))
    found = summed(rows.select(index.key, "q", part.alias("part")), index.key)
    found = found.where(_holds(query, {p: i for i, p in enumerate(phrases)})).select(index.key, "score")
    if among is not None:
        found = found.join(among.select(index.key), index.key, "left_semi")
    return found if k is None else found.orderBy(F.desc("score"), index.key).limit(k)


def okapi(index: Index, terms: list[str], k: int = 20, among: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi BM25 with idf = ln(1 + (N - n + 0.5) / (n + 0.5)); rows without tokens do not count; a repeated term counts as often."""
    wanted = {t: float(terms.count(t)) for t in terms}
    place = {t: i for i, t in enumerate(wanted)}
    own = index.postings.where(F.col("term").isin(*wanted)).select("term", index.key, F.size("positions").alias("tf"))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    stats = index.lengths.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    rows = own.join(F.broadcast(df), "term").join(index.lengths, index.key).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = S.looked_up(F.col("term"), wanted) * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = summed(rows.select(index.key, S.looked_up(F.col("term"), place).alias("q"), part.alias("part")), index.key).select(index.key, "score")
    if among is not None:
        found = found.join(among.select(index.key), index.key, "left_semi")
    return found.orderBy(F.desc("score"), index.key).limit(k)


def text_index(docs: DataFrame, key: str = "doc_id") -> Index:
    """For Okapi scores: tokens between white space, case kept."""
    return build(docs, key, {"text": F.col("text")}, space_tokens)
