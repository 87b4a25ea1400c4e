"""N-gram Jaccard join: a grouped prefix join over word shingles.

Two documents link when the Jaccard similarity of their shingle sets is at least 3/4.  The join runs in
these steps, each over all documents:

1. *Frequent shingles.*  Every map task counts the shingles of its documents and hands on its most frequent
   ones (at most ``LOCAL_FREQUENT`` per ``STEP_TOKENS`` shingles); their sums give at most ``FREQUENT`` shingles
   that are put last in the global order, rarest first.  Any total order keeps a prefix join complete; this
   one keeps shared passages out of the prefixes.
2. *Groups.*  Documents of equal sets become one member (within a map task first, then by an aggregation that
   combines before its shuffle), named by its smallest doc_id.  Members of identical prefix and size collapse into
   one group, named by its smallest member; most groups have one.
3. *Group pairs.*  The prefixes of the groups (a quarter of their shingles) are dealt by shingle; each map task
   sends a bucket one row of packed columns.  Of the groups that share a shingle, pairs with one centre are formed,
   never all pairs, and pass a size and a position filter.  Frequent shingles are dealt to several buckets, whose
   centres meet again.
4. *Expansion and verification.*  Group pairs are expanded to pairs of members (and groups to pairs with their first
   member); a bitmap filter (the parities of hashed shingles bound the overlap from above), then the full sets are
   compared exactly.
5. *Completion.*  Links give components.  A shingle whose members lie in several components gets all its pairs
   across components filtered and verified too, in cells of at most ``CELL`` by ``CELL`` members, so that no
   component is split.
6. *Links.*  All links of a member are inside its component.  They are counted exactly, in blocks of a component:
   no pairs are emitted.  This is quadratic in the different sets of a component, as the number of links is.

Shingles are compared by 64-bit hashes (48 bits of them in the exact comparison of two sets).

Edge cases: a null, empty or blank text has an empty set, links with nothing and is its own component; fewer than
five words make one shingle; a row with a null doc_id gets a null component and links with nothing of its own;
repeated rows stay, each with the same component; extra columns are ignored; an empty table gives an empty result; very
long texts are hashed whole, a text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.cluster import prepare, tidied, written
from graphloom.operators.components import components

SHINGLE_WORDS = 5
FREQUENT = 1 << 16
LOCAL_FREQUENT = 4096
STEP_TOKENS = 1 << 20
#: Prefix entries that a bucket gets on average.
BUCKET_ENTRIES = 200_000
#: Ids up to this many (8 MB) are broadcast to pick documents; more go through a shuffled join.
BROADCAST_IDS = 1_000_000
#: A bitmap has as many bits as the set has shingles, rounded up to a power of two, and at least these.
_LEAST_BITS = 1024
_U = np.uint64
#: Rows of either side of a cell of the completion join.
CELL = 512
#: Sets and bytes of shingles of a block in which links are counted, about.
BLOCK_SETS, BLOCK_BYTES = 512, 4 << 20
#: Fingerprints that a worker remembers.
KNOWN = 100_000


def _frequent_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        some = np.flatnonzero(count >= 3)
        if len(some) > LOCAL_FREQUENT:
            some = some[np.argpartition(count[some], -LOCAL_FREQUENT)[-LOCAL_FREQUENT:]]
        return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(count[some].astype(np.int64))], ["token", "n"])

    for batch in batches:
        for _, shingles in tc.shingle_sets(batch.column("text"), SHINGLE_WORDS):
            held.append(shingles)
            n += len(shingles)
            if n >= STEP_TOKENS:
                yield flush()
                held, n = [], 0
                tc.give_back()
    if n:
        yield flush()


def frequent_shingles(documents: DataFrame) -> np.ndarray:
    """At most FREQUENT shingle hashes, in ascending order of their counts: a bounded table at every size."""
    counted = documents.select("text").mapInArrow(_frequent_part, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where("n >= 16").orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.array([r.token for r in reversed(rows)], np.int64).view(_U)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The bytes of unsigned integers, plane by plane, so that equal high bytes compress."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return raw[:, :width].T.tobytes()


def _unplaned(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _prefix(shingles: np.ndarray, sorted_frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    n = len(shingles)
    length = n - (3 * n + 3) // 4 + 1
    if len(sorted_frequent):
        at = np.minimum(np.searchsorted(sorted_frequent, shingles), len(sorted_frequent) - 1)
        hit = sorted_frequent[at] == shingles
        if hit.any():
            rare = shingles[~hit]
            if len(rare) < length:
                common = shingles[hit][np.argsort(rank[at[hit]])]
                return np.concatenate([rare, common[: length - len(rare)]])
            return rare[:length]
    return shingles[:length]


def shingle_profiles(documents: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, f1, f2 for every document; ``head`` (packed prefix), ``g`` (hash of the prefix) and ``sig`` for sets that are new to a worker."""
    order = np.argsort(frequent)
    shared = documents.sparkSession.sparkContext.broadcast((frequent[order], order))  # at most 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_frequent, rank = shared.value
        known: set[int] = set()
        for batch in batches:
            n, f1, f2, g, head, sig = [], [], [], [], [], []
            for _, s in tc.shingle_sets(batch.column("text"), SHINGLE_WORDS):
                n.append(len(s))
                f1.append(int(np.sum(tc.mix(s + _U(1)))))
                f2.append(int(np.bitwise_xor.reduce(tc.mix(s ^ _U(0x5851F42D4C957F2D)))) if len(s) else 0)
                key = f1[-1] << 64 | f2[-1]
                if not len(s) or key in known:
                    g.append(None)
                    head.append(None)
                    sig.append(None)
                    continue
                if len(known) >= KNOWN:  # only saves work: a set sent twice meets again below
                    known.clear()
                known.add(key)
                prefix = _prefix(s, sorted_frequent, rank)
                g.append(int(np.sum(tc.mix(prefix + _U(7))).view(np.int64)))
                head.append(_planes(prefix >> _U(16), 6))
                bits = max(_LEAST_BITS, 1 << (len(s) - 1).bit_length())
                parity = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
                sig.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(np.array(f1, _U).view(np.int64)), pa.array(np.array(f2, _U).view(np.int64)), pa.array(g, pa.int64()), pa.array(head, pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "n", "f1", "f2", "g", "head", "sig"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, f1 long, f2 long, g long, head binary, sig array<long>")


def _dealt(groups: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Prefix entries of groups (rep, n, head, several) by bucket, a row of packed columns for each map task and bucket."""
    shared = groups.sparkSession.sparkContext.broadcast(np.unique(frequent >> _U(16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salted = shared.value
        tokens, reps, sizes, places, n, salt = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            t, r, z, p = (np.concatenate(x) for x in (tokens, reps, sizes, places))
            at = tc.mix(t)
            if len(salted):  # each flush of a task deals a frequent shingle to another bucket
                hot = salted[np.minimum(np.searchsorted(salted, t), len(salted) - 1)] == t
                at = np.where(hot, at + _U(salt), at)
            at = (at % _U(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(buckets + 1))
            rows: dict[str, list] = {"bucket": [], "tokens": [], "reps": [], "sizes": [], "places": []}
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                rows["bucket"].append(int(b))
                rows["tokens"].append(_planes(t[own], 6))
                rows["reps"].append(_planes(r[own].view(_U), 8))
                rows["sizes"].append(_planes(z[own], 4))
                rows["places"].append(_planes(p[own], 4))
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "reps", "sizes", "places"))]))

        for batch in batches:
            for rep, size, head, several in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "head", "several")), strict=True):
                t = _unplaned(head, 6)
                if not n:
                    salt = rep % 65_536
                tokens.append(t)
                reps.append(np.full(len(t), rep, np.int64))
                sizes.append(np.full(len(t), size, np.int64))
                places.append(2 * np.arange(len(t)) + several)
                n += len(t)
                if n >= STEP_TOKENS:
                    yield flush()
                    tokens, reps, sizes, places, n = [], [], [], [], 0
                    tc.give_back()
        if n:
            yield flush()

    return groups.select("rep", "n", "head", "several").mapInArrow(run, "bucket int, tokens binary, reps binary, sizes binary, places binary")


def _runs(dealt: DataFrame, frequent: np.ndarray) -> DataFrame:
    """kind 0: pair (a, b) of a centre and another group; kind 1: the groups (``members``) of a shingle that has more
    pairs than those, named by ``token``; kind 2: the centre ``a`` of a frequent shingle in this bucket."""
    shared = dealt.sparkSession.sparkContext.broadcast(np.unique(frequent >> _U(16)))
    out = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("members", pa.list_(pa.int64())), ("code", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        tc.give_back()  # what the bucket before has left
        salted = shared.value
        t, r, z, p = (np.concatenate([_unplaned(x.as_py(), w) for x in table.column(c)]) for c, w in (("tokens", 6), ("reps", 8), ("sizes", 4), ("places", 4)))
        r, z, p = r.view(np.int64), z.view(np.int64), p.view(np.int64)
        order = np.lexsort((tc.mix(r.view(_U)), t))  # centres by a random priority, the same for all shingles
        t, r, z, p = t[order], r[order], z[order], p[order]
        again = np.zeros(len(t), bool)
        again[1:] = (t[1:] == t[:-1]) & (r[1:] == r[:-1])
        t, r, z, p = t[~again], r[~again], z[~again], p[~again]
        several, p = p & 1, p >> 1
        first = np.ones(len(t), bool)
        first[1:] = t[1:] != t[:-1]
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(t)))
        head = np.repeat(start, length)
        # what both may share: at most all before this shingle, it, and the shorter rest; 7 * shared >= 3 * (sizes)
        most = np.minimum(p, p[head]) + 1 + np.minimum(z - p, z[head] - p[head]) - 1
        member = ~first & (4 * np.minimum(z, z[head]) >= 3 * np.maximum(z, z[head])) & (7 * most >= 3 * (z + z[head]))
        pairs = np.unique(np.stack([r[head[member]], r[member]], axis=1), axis=0) if member.any() else np.zeros((0, 2), np.int64)
        hot = salted[np.minimum(np.searchsorted(salted, t[start]), len(salted) - 1)] == t[start] if len(salted) else np.zeros(len(start), bool)
        code = np.add.reduceat(tc.mix(r.view(_U) + _U(3)), start) if len(start) else np.zeros(0, _U)
        wide = (length > 2) | ((length == 2) & (np.maximum.reduceat(several, start) > 0)) if len(start) else np.zeros(0, bool)
        many = np.flatnonzero(wide & ~hot)
        many = many[np.unique(code[many], return_index=True)[1]]
        many = np.concatenate([many, np.flatnonzero(hot)])
        # equal codes: the same groups under another shingle; parts of a frequent shingle's run stay apart
        code[hot] = tc.mix(tc.mix(t[start[hot]]) + _U(table.column("bucket")[0].as_py()))
        # a run goes by its code, so that rows of equal codes are alike whichever is kept; parts of a frequent
        # shingle's run go by the shingle, where they meet again
        name = np.where(hot, t[start], code)
        heads = start[hot]
        members = [r[start[i] : start[i] + length[i]] for i in many]
        k, m, h = len(pairs), len(many), len(heads)
        none = [None]
        return pa.table(
            [
                pa.array(np.repeat([0, 1, 2], [k, m, h]).astype(np.int32)),
                pa.array([*pairs[:, 0].tolist(), *none * m, *r[heads].tolist()], pa.int64()),
                pa.array([*pairs[:, 1].tolist(), *none * (m + h)], pa.int64()),
                pa.array([*none * k, *name[many].view(np.int64).tolist(), *t[heads].view(np.int64).tolist()], pa.int64()),
                pa.array([*none * k, *members, *none * h], pa.list_(pa.int64())),
                pa.array([*none * k, *code[many].view(np.int64).tolist(), *none * h], pa.int64()),
            ],
            schema=out,
        )

    return dealt.groupBy("bucket").applyInArrow(run, "kind int, a long, b long, token long, members array<long>, code long")


def _may_link(na: str, nb: str, sa: str, sb: str) -> F.Column:
    """Sizes within 3/4 of each other, and the bitmap bound (na + nb - differing bits) / 2 at least 3/7 (na + nb)."""
    half = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (x, y) -> x ^ y)"
    # sizes within 3/4 have bitmaps of equal lengths, or one twice as long, which is folded
    differ = F.expr(
        f"aggregate(zip_with(CASE WHEN size({sa}) > size({sb}) THEN {half(sa)} ELSE {sa} END,"
        f" CASE WHEN size({sb}) > size({sa}) THEN {half(sb)} ELSE {sb} END, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    )
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (7 * (F.col(na) + F.col(nb) - differ) >= 6 * (F.col(na) + F.col(nb)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f1, packed = [], []
        for _, s in tc.shingle_sets(batch.column("text"), SHINGLE_WORDS):
            f1.append(int(np.sum(tc.mix(s + _U(1)))))
            packed.append(np.ascontiguousarray((s >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(np.array(f1, _U).view(np.int64)), pa.array(packed, pa.binary())], ["rep", "f1", "shingles"])


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        last_raw, last = None, None
        for sa, sb in zip(batch.column("sa"), batch.column("sb"), strict=True):
            raw = sa.as_py()
            if raw != last_raw:
                last_raw, last = raw, _unpacked(raw)
            y = _unpacked(sb.as_py())
            at = np.minimum(np.searchsorted(last, y), len(last) - 1)
            both = int((last[at] == y).sum())
            keep.append(100 * both >= 75 * (len(last) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough to be counted in."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _sets_of(wanted: DataFrame, documents: DataFrame, groups: DataFrame) -> DataFrame:
    """rep and packed shingles of the wanted members (a written table of rep)."""
    wanted = _small(wanted)
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep", "left_semi")
    shingles = texts.mapInArrow(_sets, "rep long, f1 long, shingles binary")
    # rows that repeat a doc_id with another text are told apart by the fingerprint
    return shingles.join(groups.select("rep", "f1").join(wanted, "rep", "left_semi"), ["rep", "f1"], "left_semi").dropDuplicates(["rep"]).select("rep", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of members (a, b) whose full sets reach the threshold; ``pairs`` passed the filters."""
    rows = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    return rows.select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long")


def _relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links: components of the components before."""
    if label is None:
        return written(components(links), "label")
    side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = written(components(named).select(F.col("node").alias("component"), F.col("component").alias("_top")), "top")
    # only components that changed are in ``top``; one that had one node so far is in no row of the labels
    old = label.join(_small(top), "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    new = top.join(label.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("_top").alias("component"))
    return written(old.union(new), "label")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell (component, i, j) stand together: for each member the linked documents of the other side."""
    out = pa.schema([("rep", pa.int64()), ("others", pa.int64())])
    cell, held = None, []

    def done() -> pa.RecordBatch:
        rep, block, weight, raw = zip(*held, strict=True)
        sets = [_unpacked(x) for x in raw]
        block, weight, size = np.array(block), np.array(weight, np.float64), np.array([len(x) for x in sets])
        token, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        column = np.cumsum(count > 1) - 1
        kept = count[at] > 1
        at, row = column[at[kept]], row[kept]
        both = np.zeros((len(sets), len(sets)), np.float32)
        step = max(64, (1 << 23) // len(sets))
        for lo in range(0, int(column[-1]) + 1, step):
            x, y = np.searchsorted(at, [lo, lo + step])
            part = np.zeros((len(sets), step), np.float32)
            part[row[x:y], at[x:y] - lo] = 1
            both += part @ part.T
        link = 7 * both >= 3 * (size[:, None] + size[None])
        link &= (block[:, None] != block[None]) if cell[1] != cell[2] else ~np.eye(len(sets), dtype=bool)
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array((link @ weight).astype(np.int64))], schema=out)

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["component"], row["i"], row["j"])
            if key != cell:
                if held:
                    yield done()
                cell, held = key, []
            held.append((row["rep"], row["block"], row["weight"], row["shingles"]))
    if held:
        yield done()
    tc.give_back()


def _links(groups: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, component_id, others) of members that link: others is the number of documents of other sets that link with it."""
    members = label.join(groups.select(F.col("rep").alias("node"), "n", F.col("k").alias("weight")), "node").select(F.col("node").alias("rep"), "component", "n", "weight")
    size = written(members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("weight").alias("weights"), F.sum(6.0 * F.col("n")).alias("bytes")), "sizes")
    # a component of many members is looked up; the members of others, at most BLOCK_SETS of each, meet their size by a join
    large = _small(size.where(F.col("sets") > BLOCK_SETS))
    rest = members.join(large, "component", "left_anti").join(size.where(F.col("sets") <= BLOCK_SETS), "component")
    members = written(members.join(large, "component").unionByName(rest), "linked")
    # a component of two members is one link
    two = members.where("sets = 2").select("rep", F.col("component").alias("component_id"), (F.col("weights") - F.col("weight")).alias("others"))
    cells = members.where("sets > 2").withColumn("blocks", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("bytes") / BLOCK_BYTES)).cast("int"))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sets, "rep")
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "block", "weight", "shingles")
    found = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_counted, "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))
    many = members.where("sets > 2").select("rep", F.col("component").alias("component_id")).join(found, "rep", "left")
    return two.union(many)


def ngram_jaccard_join(documents: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, group_id (the smallest doc_id with an equal shingle set) and n_links, a row per document.

    ``n_links`` is the number of other documents with a doc_id that the document links with, copies among them; null
    with ``count_links=False``, which leaves step 6 out.
    """
    prepare(documents.sparkSession)
    return tidied(documents.sparkSession, "joined", lambda: _joined(documents.select("doc_id", "text"), count_links))


def _joined(documents: DataFrame, count_links: bool) -> DataFrame:
    spark = documents.sparkSession
    frequent = frequent_shingles(documents)
    profiles = written(shingle_profiles(documents, frequent), "profiles")
    own = profiles.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("k"), *(F.first(c, True).alias(c) for c in ("g", "head", "sig")))
    heads = written(own.where("rep IS NOT NULL"), "heads")
    groups = heads.drop("head")
    # groups of more than one member: (lead, rep), the lead among its members
    shared = groups.groupBy("n", "g").agg(F.min("rep").alias("lead"), F.count("*").alias("members")).where("members > 1").select("n", "g", "lead")
    several = written(groups.select("n", "g", "rep").join(shared, ["n", "g"]).select("lead", "rep"), "several")
    entries = heads.agg(F.sum(F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1)).first()[0] or 0
    buckets = max(1, -(-entries // BUCKET_ENTRIES), spark.sparkContext.defaultParallelism)
    single = heads.join(_small(several), "rep", "left").where("lead IS NULL OR lead = rep").select("rep", "n", "head", F.col("lead").isNotNull().cast("int").alias("several"))
    runs = written(_runs(_dealt(single, buckets, frequent), frequent), "runs")
    brief = groups.select("rep", "n", "sig")

    # Group pairs, expanded to members and filtered.
    centres = runs.where("kind = 2").select("token", "a")
    top = centres.groupBy("token").agg(F.min("a").alias("c"))
    pairs = runs.where("kind = 0").select("a", "b").union(centres.join(top, "token").where("a <> c").select(F.col("c").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = pairs.join(several.withColumnRenamed("lead", "b"), "b", "left").select("a", F.coalesce("rep", "b").alias("b"))
    pairs = pairs.union(several.where("rep <> lead").select("lead", "rep"))
    side = lambda x: brief.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("na", "nb", "sa", "sb")).select("a", "b"), "pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    sets = written(_sets_of(wanted, documents, groups), "sets")

    # First each member against one centre alone (the one that is likeliest the centre of its neighbours too); then
    # pairs that are still in two components.
    first = pairs.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a")).select("a", "b")
    links = written(_verified(first, sets), "links")
    label = _relabelled(None, links)
    side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    rest = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = written(_verified(rest, sets), "links")
    if links.limit(1).count():
        label = _relabelled(label, links)

    # Completion: runs of members that are not yet in one component.  A member that is outside the main component of
    # its run meets a 32nd of the others first, then all: most are linked by then.
    held = runs.where("kind = 1").dropDuplicates(["code"]).select("token", F.explode("members").alias("lead")).distinct()
    held = held.join(_small(several), "lead", "left").select("token", F.coalesce("rep", "lead").alias("rep"))
    held = held.union(several.select(F.xxhash64("lead"), "rep"))
    for share in (1, 32):
        held = held.select("token", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("label"))
        by_label = held.groupBy("token", "label").count()
        live = by_label.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"), F.sum("count").alias("run")).where("labels > 1")
        live = written(live.select("token", "main", F.ceil(F.col("run") / CELL).cast("int").alias("cut")), "live")
        held = written(held.join(_small(live), "token"), "open")
        cut, every = F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
        own = held.where((F.lit(share) == 32) | (F.col("label") != F.col("main")) | (F.pmod(F.xxhash64("rep", "token"), F.lit(32)) < share)).join(brief, "rep")
        x = own.where("label <> main").select("token", cut.alias("i"), every.alias("j"), *(F.col(c).alias(f"x_{c}") for c in ("rep", "label", "n", "sig")))
        y = own.where(F.pmod(F.xxhash64("rep", "token"), F.lit(32)) < share).select("token", cut.alias("j"), every.alias("i"), *(F.col(c).alias(f"y_{c}") for c in ("rep", "label", "n", "sig")))
        across = x.join(y, ["token", "i", "j"]).where("x_label <> y_label").where(_may_link("x_n", "y_n", "x_sig", "y_sig"))
        more = written(across.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct(), "more")
        if more.limit(1).count():
            lacking = more.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets.select("rep"), "rep", "left_anti")
            lacking = written(lacking, "wanted")
            if lacking.limit(1).count():
                sets = sets.union(written(_sets_of(lacking, documents, groups), "sets"))
            links = written(_verified(more, sets), "links")
            if links.limit(1).count():
                label = _relabelled(label, links)

    if count_links:
        linked = _links(groups, label, sets)
    else:
        linked = label.select(F.col("node").alias("rep"), F.col("component").alias("component_id"), F.lit(None).cast("long").alias("others"))
    named = groups.select("n", "f1", "f2", "rep", "k").join(linked, "rep", "left").select("n", "f1", "f2", "k", F.col("rep").alias("group_id"), F.coalesce("component_id", "rep").alias("component_id"), "others")
    result = profiles.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    alone, empty = F.col("doc_id").isNull(), F.col("n") == 0
    n_links = F.when(empty | alone, 0).otherwise(F.coalesce("others", F.lit(0)) + F.col("k") - 1).cast("long") if count_links else F.lit(None).cast("long")
    return result.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(~alone, F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))).alias("component_id"),
        F.when(~alone, F.when(empty, F.col("doc_id")).otherwise(F.col("group_id"))).alias("group_id"),
        n_links.alias("n_links"),
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
