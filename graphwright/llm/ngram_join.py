"""Operator 7: exact n-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles (64-bit hashes). Documents of equal sets are
one class, its smallest doc_id stands for it. Two sets that reach the threshold share at least l
tokens among the first n - ceil(t n) + l of each in any common order (l is a fixed share of n), so
every class is listed under those tokens; very frequent shingles come last in the order (a bounded
list, which only affects speed). Tokens of one class only, and classes with fewer than l shared
tokens, cannot be on a link and are peeled off. What remains is sent to the groups of its tokens.
A group is a signature tree: nodes of rising size hold the OR of their members' token bitmaps, size
range and components; a dual traversal drops node pairs whose sizes or largest possible overlap
cannot reach the threshold, or which are connected already.

Pass 1 uses the first few tokens, cuts large groups into blocks and keeps a spanning forest of the
pairs that survive; they are verified on whole sets. Pass 2 takes all tokens that still join
different components: its trees mark the documents that may be on a link with another component,
and only those come again with their whole sets, are compared at the leaves and joined if they
reach the threshold. So no link that would change a component is lost, and a group of g documents
gives at most g rows at every step, whether they are copies or just below the threshold.

Defined results: null, empty or blank text is an empty set and links with nothing; documents with
fewer words than a shingle are one shingle; rows that share a doc_id are one document
with one component, which links through any of them, n_shingles is the row's own; a null doc_id
links with nothing and its component is null; a very long text is hashed a piece at a time, its set
is held whole; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, WORD, components, extend_components, save, small_batches

WORDS, PERCENT = 4, 85
#: Tokens of pass 1, rows of a block, children of a tree node.
FIRST, BLOCK, FANOUT = 3, 128, 8
#: Thousandths of a set's tokens that a link must share among the listed ones.
SHARE = 40
#: Most tokens of the frequent list, and what makes a token frequent: copies in a chunk of tokens.
FREQUENT, CHUNK_TOKENS, CHUNK_COUNT = 1 << 17, 2_000_000, 4
#: Bytes that are hashed at a time; a piece ends before a white-space byte.
PIECE = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


class Shingler:
    """Text to the sorted distinct shingle hashes of its words.

    A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of prefix sums
    of the whole piece and then mixed with its length, so no word becomes a Python object. A-Z have
    the values of a-z.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        values = np.array([xxhash.xxh3_64_intdigest(bytes([c]).lower(), seed=1) for c in range(256)], np.uint64)
        self.space = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
        self.values = np.where(self.space, np.uint64(0), values)
        self.base = 0x9E3779B97F4A7C15
        self._powers(PIECE)

    def _powers(self, n: int) -> None:
        """Powers of the base and of its inverse, up to n."""
        inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (self.base, inverse))

    def _words(self, raw: np.ndarray) -> np.ndarray:
        """Hashes of the words of a piece."""
        n = len(raw)
        if n >= len(self.up):
            self._powers(2 * n)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~self.space[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:n], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        found, at = [], 0
        while at < len(raw):
            to = min(len(raw), at + PIECE)
            while to < len(raw) and not self.space[raw[to]]:  # a word is never cut
                gaps = np.flatnonzero(self.space[raw[to : to + PIECE]])
                to = min(len(raw), to + (int(gaps[0]) if len(gaps) else PIECE))
            found.append(self._words(raw[at:to]))
            at = to
        h = np.concatenate(found) if found else np.empty(0, np.uint64)
        if not len(h):
            return h
        words = min(self.words, len(h))  # of a shorter text, the whole sequence
        n = len(h) - words + 1
        out = h[:n] + np.uint64(words)
        for k in range(1, words):
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
            out += h[k : n + k]
        out = _mix(out)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set among which two linked sets share at least n * SHARE // 1000 + 1."""
    return min(n, n - -(-percent * n // 100) + n * SHARE // 1000 + 1)


def least_shared(percent: int) -> Column:
    """What a set of n tokens shares with any set it links to, which may be smaller by the threshold."""
    return F.floor(F.col("n") * SHARE * percent / 100_000) + 1


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, eight to sixteen a token."""
    return max(64, 1 << (8 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _frequent(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, size = Shingler(words), [], 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            at = counts >= CHUNK_COUNT
            return pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(counts[at].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.append(shingle(text.as_py()))
                size += len(held[-1])
                if size > CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return count


def frequent_tokens(docs: DataFrame, words: int = WORDS, most: int = FREQUENT) -> np.ndarray:
    """At most ``most`` of the shingles that recur within a chunk of documents, sorted. Decides the
    order of tokens only."""
    counts = docs.select("text").mapInArrow(_frequent(words), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= 2 * CHUNK_COUNT).orderBy(F.desc("n"), "token").limit(most).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64)) if len(rows) else np.empty(0, np.uint64)


def _signatures(hot, words: int, percent: int):
    """hot: a broadcast of the frequent list."""
    fields = [("doc", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, frequent = Shingler(words), hot.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    tokens = shingle(text.as_py())
                    n = len(tokens)
                    if not n:
                        rows.append((doc, 0, 0, 0, []))
                        continue
                    raw, need = tokens.tobytes(), prefix_length(n, percent)
                    if len(frequent):
                        common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
                        first = np.concatenate([tokens[~common][:need], tokens[common][: max(0, need - int((~common).sum()))]])
                    else:
                        first = tokens[:need]
                    # tokens are sorted by hash; the route is the low half of each
                    rows.append((doc, n, xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh3_64_intdigest(raw, seed=1) - (1 << 63), (first & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return sign


class _Node:
    __slots__ = ("bits", "comp", "extra", "high", "kids", "left", "low", "m", "parent", "rows")

    def __init__(self, kids, rows, bits, m, low, high, extra, comp):
        self.kids, self.rows, self.bits, self.m, self.low, self.high, self.extra, self.comp = kids, rows, bits, m, low, high, extra, comp
        self.left, self.parent = len(rows), None
        for k in kids:
            k.parent = self


def _fold(bits: int, m: int, to: int) -> int:
    while m > to:
        m //= 2
        bits = (bits >> m | bits) & ((1 << m) - 1)
    return bits


def build_tree(rows: list[tuple], fanout: int = FANOUT) -> _Node:
    """rows (doc, comp, n, bitmap), sorted by component and size; folding bitmaps to the least
    width below keeps every bound valid."""
    level = []
    for k, (_, comp, n, raw) in enumerate(rows):
        bits = int.from_bytes(raw, "little")
        level.append(_Node((), (k,), bits, 8 * len(raw), n, n, n - bits.bit_count(), comp))
    while len(level) > 1:
        up = []
        for at in range(0, len(level), fanout):
            kids = level[at : at + fanout]
            m = min(k.m for k in kids)
            bits = 0
            for k in kids:
                bits |= _fold(k.bits, k.m, m)
            # tokens that share a bit with another one, at this width
            extra = max(k.extra + k.bits.bit_count() - _fold(k.bits, k.m, m).bit_count() if not k.kids else k.extra + max(0, _lost(k, m)) for k in kids)
            comp = kids[0].comp if all(k.comp is not None and k.comp == kids[0].comp for k in kids) else None
            up.append(_Node(kids, tuple(r for k in kids for r in k.rows), bits, m, min(k.low for k in kids), max(k.high for k in kids), extra, comp))
        level = up
    return level[0]


def _lost(node: _Node, m: int) -> int:
    """Most tokens that folding to m bits can hide from a member of the node."""
    return 0 if m >= node.m else node.high


def _may(a: _Node, b: _Node, percent: int) -> bool:
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    m = min(a.m, b.m)
    x, y = _fold(a.bits, a.m, m), _fold(b.bits, b.m, m)
    if a.kids or b.kids:
        hidden = min(a.extra if a.m == m else a.high, b.extra if b.m == m else b.high)
    else:
        hidden = min(a.low - x.bit_count(), b.low - y.bit_count())
    most = min((x & y).bit_count() + hidden, a.high, b.high)
    return (100 + percent) * most >= percent * (a.low + b.low)


def _descend(root: _Node, percent: int, decided) -> Iterator[tuple[int, int]]:
    """Dual traversal: the pairs of rows that the bounds leave open, without the node pairs that
    ``decided`` already knows."""
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if a is not b:
            if a.comp is not None and a.comp == b.comp or decided(a, b) or not _may(a, b, percent):
                continue
        elif a.comp is not None and a.kids:
            continue
        if not a.kids and not b.kids:
            if a is not b:
                yield a.rows[0], b.rows[0]
        elif a is b:
            stack += [(x, y) for k, x in enumerate(a.kids) for y in a.kids[k:]]
        elif not b.kids or a.kids and len(a.rows) >= len(b.rows):
            stack += [(x, b) for x in a.kids]
        else:
            stack += [(a, y) for y in b.kids]


def _in_order(row: tuple) -> tuple:
    return (row[1], row[2], row[0]) if row[1] is not None else (0, row[2], row[0])


def tree_links(rows: list[tuple], percent: int = PERCENT, check=None) -> list[tuple[int, int]]:
    """rows (doc, comp, n, bitmap, ..): a spanning forest of the pairs of different components that
    may reach the threshold, or, if check(row, row) is given, of those that it confirms; at most
    one pair fewer than rows."""
    rows = sorted(rows, key=_in_order)
    root = build_tree([r[:4] for r in rows])
    up, seen = list(range(len(rows))), {}
    for k, r in enumerate(rows):
        if r[1] is not None:
            up[k] = seen.setdefault(r[1], k)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in _descend(root, percent, lambda a, b: not a.kids and not b.kids and find(a.rows[0]) == find(b.rows[0])):
        x, y = find(i), find(j)
        if x != y and (check is None or check(rows[i], rows[j])):
            up[x] = y
            out.append((rows[i][0], rows[j][0]))
    return out


def tree_survivors(rows: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(doc, comp) of the rows that may reach the threshold with a row of another component. Two
    nodes whose rows are all known to be such need no look at each other."""
    rows = sorted(rows, key=_in_order)
    level, leaves = [build_tree(rows)], {}
    root = level[0]
    while level:
        leaves.update((n.rows[0], n) for n in level if not n.kids)
        level = [k for n in level for k in n.kids]
    for i, j in _descend(root, percent, lambda a, b: not a.left and not b.left):
        for k in (i, j):
            node = leaves[k]
            if node.left:
                while node is not None:
                    node.left -= 1
                    node = node.parent
    return [(rows[k][0], rows[k][1]) for k, node in leaves.items() if not node.left]


def _by_key(solve, names: tuple[str, ...]):
    """Streams rows sorted by key; solve(key, rows) gives the columns' values, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def give(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], list(names))

        for batch in batches:
            for now, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "comp", "n", "v")), strict=True):
                if now != key:
                    if len(rows) > 1 and (found := solve(key, rows)):
                        yield give(found)
                    key, rows = now, []
                rows.append(tuple(row))
        if len(rows) > 1 and (found := solve(key, rows)):
            yield give(found)

    return run


def _candidates(percent: int):
    """v is a bitmap; pairs that may be links."""
    return _by_key(lambda key, rows: [(min(p), max(p)) for p in tree_links(rows, percent)], ("a", "b"))


def _survivors(percent: int):
    """v is a bitmap; the rows that may be on a link."""
    return _by_key(lambda key, rows: [(key, *r) for r in tree_survivors(rows, percent)], ("key", "doc", "comp"))


def _verified(percent: int):
    """v is the set itself; pairs that are links."""

    def solve(key: int, rows: list[tuple]) -> list[tuple]:
        sets = [np.frombuffer(v, np.uint64) for _, _, _, v in rows]
        rows = [(doc, comp, n, bitmap(s, width(n)), s) for (doc, comp, n, _), s in zip(rows, sets, strict=True)]
        return [(min(p), max(p)) for p in tree_links(rows, percent, lambda x, y: links(x[4], y[4], percent))]

    return _by_key(solve, ("a", "b"))


def _in_groups(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows (key, doc, comp, n, v) through one tree a key."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle(t.as_py()) for t in part.column("text")]
                columns = [part.column("doc_id"), pa.array([len(t) for t in sets], pa.int64()), pa.array([bitmap(t, width(len(t))) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "bits", "tokens"])

    return run


def _checked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    out = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    return save(out.select("a", "b", "x", "y").mapInArrow(_checked(percent), "a long, b long").distinct(), "links")


def distinct_groups(rows: DataFrame) -> DataFrame:
    """rows (token, doc, ..) of one token for each set of documents: copies share most of their
    tokens, and groups of the same documents would all do the same work."""
    h = F.xxhash64("doc")
    groups = rows.groupBy("token").agg(F.bit_xor(h).alias("x1"), F.bit_xor(F.xxhash64(F.lit("group"), "doc")).alias("x2"), F.count("*").alias("size"))
    kept = groups.groupBy("x1", "x2", "size").agg(F.min("token").alias("token"))
    return rows.join(kept.select("token", "size"), "token")


def peel(rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """rows (token, doc, n, pos, ..) without documents that have too few tokens for a link, then
    without tokens that no longer join two documents (kind doc) or components (kind comp)."""
    for _ in range(2 if kind == "comp" else 1):
        enough = rows.groupBy("doc", "n").agg(F.count("*").alias("k")).where(F.col("k") >= least_shared(percent)).select("doc", "n")
        rows = rows.join(enough, ["doc", "n"], "left_semi")
        both = rows.groupBy("token").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo < hi").select("token")
        rows = rows.join(both, "token", "left_semi")
    return rows


def _across(now: DataFrame, percent: int, block: int) -> DataFrame:
    """(doc, comp, key): the tasks in which documents of one token but other components meet. A
    document goes only to as many of its tokens as a link cannot avoid. Where a token has more than
    a block of documents, only those of like size meet: a document goes to its own band of sizes
    and the one below, bands being as wide as a link can be. The most frequent component of a band
    is cut into blocks that never meet each other."""
    order = Window.partitionBy("doc").orderBy("pos")
    now = now.withColumn("rank", F.row_number().over(order)).withColumn("k", F.count("*").over(Window.partitionBy("doc")))
    now = distinct_groups(now.where(F.col("rank") <= F.col("k") - least_shared(percent) + 1))
    band = F.floor(F.log(F.col("n").cast("double")) / (max(math.log(100 / percent), 0.01) * 1.000001)).cast("int")
    bands = F.when(F.col("size") > block, F.array(band, band - 1)).otherwise(F.array(F.lit(-2)))
    now = now.select("doc", "comp", "token", F.explode(bands).alias("band")).select("doc", "comp", F.xxhash64("token", "band").alias("group"))
    counts = now.groupBy("group", "comp").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("group").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    mixed = mixed.select("group", F.col("top.comp").alias("most"), F.ceil((F.col("all") - F.col("top.k")) / block).cast("int").alias("others"), F.ceil(F.col("top.k") / block).cast("int").alias("mosts"))
    most, h = F.col("comp") == F.col("most"), F.xxhash64("doc", "group")
    own = F.when(most, F.pmod(h, "mosts")).otherwise(F.pmod(h, "others")).cast("int")
    two = now.join(mixed, "group").select("group", "doc", "comp", most.alias("m"), own.alias("own"), "others", "mosts")
    across = F.when(F.col("m"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.col("own").alias("x"), o.alias("y"))))
    across = across.otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("mosts") - 1), lambda d: F.struct(d.alias("x"), F.col("own").alias("y"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.col("others") > 1), lambda o: F.struct((-1 - F.least(o, F.col("own"))).alias("x"), F.greatest(o, F.col("own")).alias("y"))),
        )
    )
    return two.select("doc", "comp", F.explode(across).alias("cell"), "group").select("doc", "comp", F.xxhash64("group", "cell").alias("key"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    with small_batches(docs.sparkSession):
        return _jaccard_components(docs, words, percent, block, first)


def _jaccard_components(docs: DataFrame, words: int, percent: int, block: int, first: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = spark.sparkContext.broadcast(frequent_tokens(docs, words))
    signed = save(docs.mapInArrow(_signatures(hot, words, percent), "doc long, n long, s1 long, s2 long, prefix array<int>"), "signed")
    classes = save(signed.where("n > 0 and doc is not null").groupBy("s1", "s2").agg(F.min("doc").alias("rep")), "classes")
    reps = signed.where("n > 0").join(classes.withColumnRenamed("rep", "doc"), ["s1", "s2", "doc"], "left_semi").dropDuplicates(["s1", "s2", "doc"])
    reps = save(reps.select("doc", "n", "prefix"), "reps")
    posts = reps.select("doc", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("token")
    members = save(posts.join(shared, "token").select("token", "doc", "n", "pos"), "members")
    members = save(peel(members, "doc", percent), "members")
    # the only time that texts move, those of documents that may be on a link
    sets = docs.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(words), "doc long, n long, bits binary, tokens binary")
    sets = save(sets, "sets")  # a repeated id comes more than once, which later distincts absorb
    signs = sets.select("doc", "n", "bits")

    one = distinct_groups(members.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).where(F.col("rank") <= first))
    one = one.where("size > 1").select("doc", F.xxhash64("token", F.pmod(F.xxhash64("doc", "token"), F.ceil(F.col("size") / block))).alias("key"))
    one = one.join(signs, "doc").select("key", "doc", F.lit(None).cast("long").alias("comp"), "n", F.col("bits").alias("v"))
    pairs = save(_in_groups(one, _candidates(percent), "a long, b long").distinct(), "pairs")
    several = _several(signed, classes)
    comps = components(verified(sets, pairs, percent).unionAll(several.select("a", "b")))
    now = members.join(comps.withColumnRenamed("id", "doc"), "doc", "left").withColumn("comp", F.coalesce("component_id", "doc")).drop("component_id")
    now = save(peel(now, "comp", percent), "open")
    two = _across(now, percent, 4 * block).join(signs, "doc").select("key", "doc", "comp", "n", F.col("bits").alias("v"))
    left = save(_in_groups(two, _survivors(percent), "key long, doc long, comp long"), "left")
    left = distinct_groups(left.withColumnRenamed("key", "token")).withColumnRenamed("token", "key")
    whole = left.join(sets, "doc").select("key", "doc", "comp", "n", F.col("tokens").alias("v"))
    found = save(_in_groups(whole, _verified(percent), "a long, b long").distinct(), "links")
    comps = extend_components(comps, found)

    classes = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("component_id", "rep").alias("comp"))
    out = signed.select("doc", "n", "s1", "s2").join(classes, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    alone = F.when((F.col("n") == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(F.col("comp"))
    out = out.select("doc", "n", alone.alias("comp"))
    ids = several.select(F.col("doc").alias("id")).distinct()
    if not ids.isEmpty():  # a document with rows without words: as its other rows
        least = out.join(ids, F.col("doc") == F.col("id")).groupBy("id").agg(F.min("comp").alias("least"))
        out = out.join(least, F.col("doc") == F.col("id"), "left").select("doc", "n", F.coalesce("least", "comp").alias("comp"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def _several(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, a, b): links between the representatives of the sets that one doc_id has, if several."""
    rows = signed.where("doc is not null").groupBy("doc").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo <> hi")
    mine = signed.where("doc is not null").join(rows.select("doc"), "doc", "left_semi").select("doc", "n", "s1", "s2").distinct()
    mine = mine.join(classes, ["s1", "s2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")))
    return save(mine.select("doc", F.col("doc").alias("a"), F.coalesce("rep", "doc").alias("b")), "several")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: set size and component of every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Shingles as strings, links by a self-join on them, components by closure: for small tables.
SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {WORDS} then list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {PERCENT} * (x.n + y.n - k)),
p as (select a, b from l union all select b, a from l),
r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce((select min(b) from r where r.a = d.doc_id), d.doc_id)) as component_id
from d left join n on n.doc_id = d.doc_id
"""
