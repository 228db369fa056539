"""Operator 8: exact near duplicates among embeddings by cover-tree dual traversal.

Vectors are compared within a label (and dimension). Equal vectors are one class, weighted by its
rows. The upper tier of the tree assigns every class to its nearest pivot of the label
(farthest-first among a bounded sample; pivots only affect speed); cells of many vectors are cut
into blocks. One cover tree is built for each block, by insertion: nested levels of halving radii,
each node with its covering radius, kept as one row of arrays. Pairs of blocks whose covering radii
cannot reach each other are dropped; for each other pair both trees are descended together over a
list of live node pairs: pairs beyond the threshold are dropped, pairs wholly within it count at
once, and only points of nodes that stay undecided are compared, in double precision.

Tasks return counts and a spanning forest, not pairs, so a group of g near copies gives O(g) rows.
Joins by label are salted, and pairs of blocks are made on a grid, so that no label is one task.

Defined results: a vector with a null label, null or zero embedding, or a null or non-finite
component links with nothing and is its own component; repeated rows are vectors of their own and
link with each other; rows that share a vec_id have the links of their own vector, and their links
join in one component; a null vec_id links with nothing and has a null component; no rows give no
rows; other columns are ignored. A vector is one value, however long.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, save, small_batches

COSINE = 0.93
#: Vectors of a block and most bytes of one; pivots of a label at most; vectors a label's pivots
#: are chosen from (about); copies of the small side of a join by label; block rows of a grid cell.
BLOCK, BLOCK_BYTES, PIVOTS, SAMPLE, SALTS, GRID = 1024, 1 << 23, 64, 1024, 32, 128
#: What rounding may add to a distance.
SLACK = 1e-7


def chord(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


class Distances:
    """Distances between unit vectors, with the number computed so far."""

    def __init__(self):
        self.n = 0

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        self.n += len(x) * len(y)
        return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


class CoverTree:
    """Nested levels over unit vectors. Level 0 is one centre; from level to level the radius is
    halved: a node's centre and the points near it stay, and each point left over becomes a centre
    with those near to it. ``order`` lists the points so that a node's are a stretch of it; a level
    is (centres, starts, ends, covering radii, first child, end of children), by node."""

    def __init__(self, x: np.ndarray, least: float, distances: Distances):
        rows = np.arange(len(x))
        d = distances(x, x[:1])[:, 0]
        reach, level, nested = float(d.max()), [(0, rows, d)], []
        while True:
            nested.append(level)
            if reach <= least or all(len(points) == 1 for _, points, _ in level):
                break
            reach /= 2
            level, below = [], level
            for at, (center, points, d) in enumerate(below):
                near = d <= reach
                level.append((center, points[near], d[near], at))
                rest = points[~near]
                while len(rest):
                    away = distances(x[rest], x[rest[:1]])[:, 0]
                    away[0], near = 0.0, away <= reach
                    near[0] = True
                    level.append((int(rest[0]), rest[near], away[near], at))
                    rest = rest[~near]
            nested[-1] = (below, np.array([node[3] for node in level]))
            level = [node[:3] for node in level]
        self.order = np.concatenate([points for _, points, _ in nested[-1]])
        ends = np.cumsum([len(points) for _, points, _ in nested[-1]])
        starts = ends - [len(points) for _, points, _ in nested[-1]]
        radius = lambda nodes: np.array([float(d.max(initial=0.0)) for _, _, d in nodes])
        center = lambda nodes: np.array([c for c, _, _ in nodes], np.int64)
        self.levels = [(center(nested[-1]), starts, ends, radius(nested[-1]), None, None)]
        for nodes, parent in reversed(nested[:-1]):
            first = np.searchsorted(parent, np.arange(len(nodes)))
            last = np.searchsorted(parent, np.arange(len(nodes)), side="right")
            below = self.levels[0]
            self.levels.insert(0, (center(nodes), below[1][first], below[2][last - 1], radius(nodes), first, last))

    @classmethod
    def of(cls, order: np.ndarray, levels: list[tuple]) -> CoverTree:
        tree = cls.__new__(cls)
        tree.order, tree.levels = order, levels
        return tree

    def level(self, k: int):
        if k < len(self.levels) - 1:
            return self.levels[k]
        centers, starts, ends, radius, _, _ = self.levels[-1]  # a finished tree waits for the other one
        return centers, starts, ends, radius, np.arange(len(centers)), np.arange(1, len(centers) + 1)


def _stretches(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. and so on."""
    n = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _groups(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Partners of every i, by rising i."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.diff(i)) + 1
    for part_i, part_j in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
        if len(part_i):
            yield int(part_i[0]), part_j


def dual(a: CoverTree, x: np.ndarray, wx: np.ndarray, b: CoverTree, y: np.ndarray, wy: np.ndarray, same: bool, cosine: float, distances: Distances):
    """(links of each x, links of each y, forest edges between places of x and of y). x, y: raw
    vectors; wx, wy: how many rows each one stands for. same: b is a, pairs are taken once."""
    most, ux, uy = chord(cosine), _unit(x), _unit(y)
    nx, ny, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    i, j, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), max(len(a.levels), len(b.levels))
    for k in range(depth):
        (ca, sa, ea, ra, fa, la), (cb, sb, eb, rb, fb, lb) = a.level(k), b.level(k)
        live = []
        for p, q in _groups(i, j):
            d = distances(ux[ca[p : p + 1]], uy[cb[q]])[0]
            r = ra[p] + rb[q]
            within = d + r < most - SLACK
            for t in q[within]:
                left, right = a.order[sa[p] : ea[p]], b.order[sb[t] : eb[t]]
                nx[left] += wy[right].sum()
                if same and t == p:
                    nx[left] -= wx[left]  # not itself
                else:
                    ny[right] += wx[left].sum()
                edges += [(left, np.full(len(left), right[0])), (np.full(len(right), left[0]), right)]
            q = q[~within & (d - r <= most + SLACK)]
            if len(q):
                live.append((p, q))
        if not live:
            return nx, ny, edges
        if k + 1 < depth:
            i, j = [], []
            for p, q in live:
                left, right = np.arange(fa[p], la[p]), _stretches(fb[q], lb[q])
                u, v = np.repeat(left, len(right)), np.tile(right, len(left))
                if same:
                    u, v = u[u <= v], v[u <= v]
                i.append(u)
                j.append(v)
            i, j = np.concatenate(i), np.concatenate(j)
    for p, q in live:
        left, right = a.order[sa[p] : ea[p]], b.order[_stretches(sb[q], eb[q])]
        distances.n += len(left) * len(right)
        dot = ux[left] @ uy[right].T
        linked = dot >= cosine
        for u, v in zip(*np.nonzero(np.abs(dot - cosine) < 1e-9), strict=True):  # as the definition has it
            s, t = x[left[u]], y[right[v]]
            linked[u, v] = s @ t / (np.sqrt(s @ s) * np.sqrt(t @ t)) >= cosine
        if same and p in q:  # of the pairs within a node, each once
            at = int((eb[q] - sb[q])[: int(np.flatnonzero(q == p)[0])].sum())
            linked[:, at : at + len(left)] &= np.triu(np.ones((len(left), len(left)), bool), 1)
        nx[left] += linked @ wy[right]
        ny[right] += wx[left] @ linked
        u, v = np.nonzero(linked)
        edges.append((left[u], right[v]))
    return nx, ny, edges


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least place reachable from every one of n places over the edges (u, v)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1))[:, None]


def _pivots(most: int):
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rep", "h"])
        x = _unit(np.stack([np.frombuffer(v, np.float64) for v in rows["v"]]))
        n = int(min(most, max(1, rows["size"].iloc[0] // BLOCK), len(x)))
        chosen, d = [0], np.sqrt(np.maximum(0, 2 - 2 * (x @ x[0])))
        while len(chosen) < n:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[chosen[-1]]))))
        return pd.DataFrame({"label": rows["label"].iloc[:1].to_numpy(), "dim": rows["dim"].iloc[:1].to_numpy(), "pivots": [x[chosen].tobytes()]})

    return choose


COLUMNS = ("label", "dim", "h", "rep", "weight", "size", "v")


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest pivot of every vector."""
    for batch in batches:
        cells = []
        for v, dim, pivots in zip(batch.column("v"), batch.column("dim").to_pylist(), batch.column("pivots"), strict=True):
            x = np.frombuffer(v.as_py(), np.float64)
            cells.append(int((np.frombuffer(pivots.as_py(), np.float64).reshape(-1, dim) @ x).argmax()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), pa.array(cells, pa.int32())], [*COLUMNS, "cell"])


def _trees(cosine: float):
    """One row a block: the centre and covering radius of its tree, and the tree with its vectors."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rep", "h"])
        raw = np.stack([np.frombuffer(v, np.float64) for v in rows["v"]])
        x = _unit(raw)
        tree = CoverTree(x, chord(cosine) / 4, Distances())
        flat = raw.astype(np.float32)
        held = (tree.order, tree.levels, flat if (flat == raw).all() else raw, rows["rep"].to_numpy(np.int64), rows["h"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64))
        first = rows.iloc[:1]
        return pd.DataFrame({"label": first["label"].to_numpy(), "dim": first["dim"].to_numpy(), "node": first["node"].to_numpy(), "radius": [float(tree.levels[0][3][0])], "c": [x[0].tobytes()], "block": [pickle.dumps(held)]})

    return build


def _reach(cosine: float):
    """Keeps the pairs of blocks whose covering balls come within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, j, ri, rj, ci, cj in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "ri", "rj", "ci", "cj")), strict=True):
                d = float(np.linalg.norm(np.frombuffer(ci, np.float64) - np.frombuffer(cj, np.float64)))
                keep.append(i == j or d - ri - rj <= chord(cosine) + SLACK)
            yield batch.select(["label", "dim", "i", "j"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tasks(cosine: float):
    """Streams the one or two blocks of every pair, sorted by key; gives (a, h, b, n): n links of the
    class h with id a if b is null, else an edge between the ids a and b."""

    def solve(blocks: list[bytes]) -> list[tuple]:
        (order, levels, x, ids, h, w), same = pickle.loads(blocks[0]), len(blocks) == 1
        tree, x = CoverTree.of(order, levels), x.astype(np.float64)
        if same:
            nx, ny, edges = dual(tree, x, w, tree, x, w, True, cosine, Distances())
            n, offset = nx + ny, 0
        else:
            order, levels, y, ids_y, h_y, w_y = pickle.loads(blocks[1])
            nx, ny, edges = dual(tree, x, w, CoverTree.of(order, levels), y.astype(np.float64), w_y, False, cosine, Distances())
            n, offset = np.concatenate([nx, ny]), len(ids)
            ids, h = np.concatenate([ids, ids_y]), np.concatenate([h, h_y])
        out = [(int(ids[k]), int(h[k]), None, int(n[k])) for k in np.flatnonzero(n)]
        if edges:
            root = forest(len(ids), np.concatenate([u for u, _ in edges]), np.concatenate([v for _, v in edges]) + offset)
            out += [(int(ids[k]), 0, int(ids[r]), 0) for k, r in enumerate(root) if k != r]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []

        def give(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "h", "b", "n"])

        for batch in batches:
            for now, block in zip(batch.column("key").to_pylist(), batch.column("block"), strict=True):
                if now != key:
                    if blocks and (found := solve(blocks)):
                        yield give(found)
                    key, blocks = now, []
                blocks.append(block.as_py())
        if blocks and (found := solve(blocks)):
            yield give(found)

    return run


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [np.asarray(x.as_py(), np.float64).tobytes() for x in batch.column("e")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "h", "rep", "weight")), pa.array(v, pa.binary())], ["label", "dim", "h", "rep", "weight", "v"])


def _salted(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """big joined with small (a few rows a label) so that the rows of a key are dealt over tasks."""
    big = big.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.join(small, [*keys, "salt"]).drop("salt")


def _pairs_of_blocks(nodes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(label, dim, i, j), i <= j: pairs that may hold a link, made on a grid of the label's blocks."""
    counts = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / GRID).cast("int").alias("slots"))
    rows = nodes.join(counts, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), "slots").cast("int"))
    every = F.sequence(F.lit(0), F.col("slots") - 1)
    x = rows.select("label", "dim", F.col("own").alias("u"), F.explode(every).alias("v"), F.col("node").alias("i"), F.col("radius").alias("ri"), F.col("c").alias("ci"))
    y = rows.select("label", "dim", F.explode(every).alias("u"), F.col("own").alias("v"), F.col("node").alias("j"), F.col("radius").alias("rj"), F.col("c").alias("cj"))
    return x.join(y, ["label", "dim", "u", "v"]).where("i <= j").mapInArrow(_reach(cosine), f"label {kind}, dim int, i long, j long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, embedding, label)."""
    with small_batches(vectors.sparkSession, rows=256):
        return _near_duplicates(vectors, cosine, block, pivots)


def _near_duplicates(vectors: DataFrame, cosine: float, block: int, pivots: int) -> DataFrame:
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("e"), F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)).alias("ok"))
    rows = rows.withColumn("h", F.xxhash64("label", "e")).withColumn("h2", F.xxhash64(F.lit("v"), "label", "e"))
    classes = rows.where("ok").groupBy("label", "h", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    one = rows.where("ok").select("h", "h2", F.col("vec_id").alias("rep"), "e").dropDuplicates(["h", "h2", "rep"])
    classes = save(classes.join(one, ["h", "h2", "rep"]).select("label", F.size("e").alias("dim"), "h", "h2", "rep", "weight", "e"), "classes")
    kind = rows.schema["label"].dataType.simpleString()
    reps = save(classes.select("label", "dim", "h", "rep", "weight", "e").mapInArrow(_doubles, f"label {kind}, dim int, h long, rep long, weight long, v binary"), "reps")
    sized = _salted(reps, reps.groupBy("label", "dim").agg(F.count("*").alias("size")), ["label", "dim"])
    some = sized.where((F.col("size") <= SAMPLE) | (F.pmod(F.xxhash64("h"), F.col("size")) < SAMPLE))
    some = some.select(*COLUMNS).unionByName(sized.groupBy("label", "dim").agg(F.min_by(F.struct("h", "rep", "weight", "size", "v"), "h").alias("s")).select("label", "dim", "s.*"))
    centers = save(some.groupBy("label", "dim").applyInPandas(_pivots(pivots), f"label {kind}, dim int, pivots binary"), "pivots")
    cells = _salted(sized, centers, ["label", "dim"]).mapInArrow(_assign, f"label {kind}, dim int, h long, rep long, weight long, size long, v binary, cell int")
    cells = save(cells, "cells")
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(BLOCK_BYTES / (8 * F.col("dim")))))
    counts = cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).select("label", "dim", "cell", F.ceil(F.col("n") / most).alias("blocks"))
    placed = _salted(cells, counts, ["label", "dim", "cell"]).withColumn("node", F.col("cell") * F.lit(1 << 40).cast("long") + F.pmod(F.xxhash64("h"), "blocks"))
    placed = placed.select("label", "dim", "node", "h", "rep", "weight", "v")
    trees = save(placed.groupBy("label", "dim", "node").applyInPandas(_trees(cosine), f"label {kind}, dim int, node long, radius double, c binary, block binary"), "trees")

    near = save(_pairs_of_blocks(trees.select("label", "dim", "node", "radius", "c"), cosine, kind), "near")
    sides = near.select("label", "dim", F.col("i").alias("node"), "i", "j").unionAll(near.where("i <> j").select("label", "dim", F.col("j").alias("node"), "i", "j"))
    tasks = trees.join(sides, ["label", "dim", "node"]).select(F.xxhash64("label", "dim", "i", "j").alias("key"), "node", "block")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = save(tasks.repartition(n, "key").sortWithinPartitions("key", "node").select("key", "block").mapInArrow(_tasks(cosine), "a long, h long, b long, n long"), "found")
    degree = found.where("b is null").groupBy(F.col("a").alias("rep"), "h").agg(F.sum("n").alias("far"))
    several = rows.where("ok").groupBy("vec_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("vec_id")
    held = rows.where("ok").join(several, "vec_id", "left_semi").select("vec_id", "h", "h2").join(classes.select("h", "h2", "rep"), ["h", "h2"])
    edges = found.where("b is not null").select("a", "b").unionAll(held.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    comps = components(edges).withColumnRenamed("id", "rep")
    facts = classes.select("h", "h2", "rep", "weight").join(degree, ["rep", "h"], "left").join(comps, "rep", "left")
    facts = facts.select(F.col("h").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("far", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "ok", "h", "h2").join(facts, F.col("ok") & (F.col("h") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: links and component of every vector."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and vec_id is not null),
w as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_aggregate(list_transform(e, lambda x: x * x), 'sum') > 0),
p as (select a.vec_id as a, b.vec_id as b from w a join w b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
select e.vec_id, (select count(*) from p where p.a = e.vec_id)::bigint as n_links,
       least(e.vec_id, coalesce((select min(r.b) from r where r.a = e.vec_id), e.vec_id)) as component_id,
       least(e.vec_id, coalesce((select min(r.b) from r where r.a = e.vec_id), e.vec_id)) = e.vec_id as kept
from embeddings e
"""
