"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut

#: Cosine from which vectors link; trees at least; rows of a leaf, about; share of a node's rows on each side of a split that go to both.
COSINE, TREES, LEAF, SPILL = 0.9, 10, 512, 0.05
#: Vectors that the trees are fitted on at most (those of the smallest hash of vec_id); least of them in a leaf.
SAMPLE, LEAST_SAMPLE = 8192, 8
#: A node isn't split further where so large a share of its sampled pairs link: a dense group stays together.
DENSE = 0.1
#: Trees are added until this share of pairs made at the bound meet in a leaf; such pairs at most.
MEET, PAIRS = 0.995, 2048
#: Leaves of more than two blocks are split again, each by at most SUBSAMPLE of its vectors, about; levels of such splits; nodes of
#: all trees at most (40 bytes each in the broadcast forest), beyond which leaves stay as they are.
SUBSAMPLE, LEVELS, NODES = 1024, 40, 2_000_000
#: Rows of a block; larger leaves are compared block by block. Rows of a tile of the comparison.
BLOCK, TILE, SEED = 2048, 1024, 5


@dataclass
class Tree:
    """Nodes: row of their direction, borders (left takes up to `high`, right from `low` on), children; leaves have a number. The
    last LEVELS directions are for leaves that are split again, one for each level below the first leaf (`level`)."""

    directions: np.ndarray
    way: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    level: np.ndarray

    def graft(self, split: dict[int, tuple], number: int) -> int:
        """Put the nodes of `split` (low, high, left, right by leaf; children count from the leaf as 0) in the place of leaves."""
        names = ("way", "low", "high", "left", "right", "leaf", "level")
        new: dict[str, list] = {n: [getattr(self, n)] for n in names}
        size, first = len(self.leaf), len(self.directions) - LEVELS
        for node in np.flatnonzero(np.isin(self.leaf, list(split))):
            low, high, left, right = (np.asarray(v) for v in split[int(self.leaf[node])])
            at = np.arange(len(low)) + size - 1  # of the nodes below the first, which takes the leaf's place
            at[0] = node
            level = np.full(len(low), self.level[node])
            for i in range(len(low)):  # parents come before their children
                if left[i] >= 0:
                    level[left[i]] = level[right[i]] = level[i] + 1
            ends = left < 0
            leaf = np.full(len(low), -1)
            leaf[ends] = number + np.arange(ends.sum())
            number += int(ends.sum())
            values = {"way": np.where(ends, -1, first + level), "low": low, "high": high, "left": np.where(ends, -1, at[left]), "right": np.where(ends, -1, at[right]), "leaf": leaf, "level": level}
            for n in names:
                getattr(self, n)[node] = values[n][0]
                new[n].append(values[n][1:])
            size += len(low) - 1
        for n in names:
            setattr(self, n, np.concatenate(new[n]))
        return number

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves of x, a row for each leaf that takes it."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if self.leaf[node] >= 0:
                rows.append(own)
                leaves.append(np.full(len(own), self.leaf[node]))
                continue
            at = x[own] @ self.directions[self.way[node]]
            todo.append((self.left[node], own[at <= self.high[node]]))
            todo.append((self.right[node], own[at >= self.low[node]]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _unit(vectors: list, size: int | None = None) -> np.ndarray:
    """Unit vectors in double precision, padded or cut to `size`; scaled first, so that squares stay finite."""
    size = size or max((len(v) for v in vectors), default=0)
    x = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        x[i, : min(size, len(v))] = v[:size]
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 5e-324)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 5e-324)


def hard_pairs(sample: np.ndarray, cosine: float, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, and for each another one made at `cosine` to it that varies about the sample's mean as the sample does."""
    rng = np.random.default_rng(SEED + 1)
    x = sample[rng.choice(len(sample), min(most, len(sample)), replace=False)]
    mean = sample.mean(axis=0)
    own, other = x - mean, sample[rng.choice(len(sample), len(x))] - mean
    norm2 = (own * own).sum(axis=1, keepdims=True)
    other -= own * (own * other).sum(axis=1, keepdims=True) / np.maximum(norm2, 1e-300)
    other *= np.sqrt(norm2 / np.maximum((other * other).sum(axis=1, keepdims=True), 1e-300))

    def mixed(part: np.ndarray) -> np.ndarray:
        y = mean + part * own + np.sqrt(1 - part * part) * other
        return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)

    low, high = np.zeros((len(x), 1)), np.ones((len(x), 1))
    for _ in range(40):
        part = (low + high) / 2
        near = (x * mixed(part)).sum(axis=1, keepdims=True) >= cosine
        low, high = np.where(near, low, part), np.where(near, part, high)
    return x, mixed(high)


def meeting(tree: Tree, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether x[i] and y[i] share a leaf."""
    keys = [rows * len(tree.leaf) + np.searchsorted(np.unique(tree.leaf), leaves) for rows, leaves in (tree.route(x), tree.route(y))]
    out = np.zeros(len(x), bool)
    out[np.intersect1d(*keys) // len(tree.leaf)] = True
    return out


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, cosine: float = COSINE, seed: int = SEED, first: int = 0) -> list[Tree]:
    """Trees for `rows` vectors from a sample of unit vectors: random directions, split at the sample's median.

    At least `trees`; more where pairs made at the bound do not meet often enough (deep trees, vectors with a common mean). Where
    so many would be needed that comparing everything costs less, one leaf takes all. Leaves are numbered from `first`.
    """
    rng = np.random.default_rng(seed)
    least = max(LEAST_SAMPLE, int(leaf * len(sample) / max(1, rows)))
    out, number = [], first
    x, y = hard_pairs(sample, cosine)
    met, work = np.zeros(len(x), bool), 0.0  # work: comparisons, as a share of all pairs
    while len(out) < trees or met.mean() < MEET:
        if len(out) >= trees and work >= 1:
            return [Tree(np.zeros((LEVELS, sample.shape[1])), np.full(1, -1), *np.zeros((2, 1)), *np.full((2, 1), -1), np.full(1, first), np.full(1, LEVELS))]
        nodes: list[list] = []

        def grow(own: np.ndarray) -> int:
            nonlocal number
            me = len(nodes)
            nodes.append([np.zeros(sample.shape[1]), 0.0, 0.0, -1, -1, -1])
            if len(own) > least:
                some = sample[rng.choice(own, min(64, len(own)), replace=False)]
                pairs = (some @ some.T)[np.triu_indices(len(some), 1)]
                d = rng.normal(size=sample.shape[1])
                d /= np.linalg.norm(d)
                at = sample[own] @ d
                low, high = np.quantile(at, [0.5 - spill, 0.5 + spill])
                left, right = own[at <= high], own[at >= low]
                if (pairs >= cosine).mean() < DENSE and max(len(left), len(right)) < len(own):
                    nodes[me][:3] = d, low, high
                    nodes[me][3] = grow(left)
                    nodes[me][4] = grow(right)
                    return me
            nodes[me][5] = number
            number += 1
            return me

        grow(np.arange(len(sample)))
        d, low, high, left, right, leaves = zip(*nodes, strict=True)
        more = rng.normal(size=(LEVELS, sample.shape[1]))
        more /= np.linalg.norm(more, axis=1, keepdims=True)
        out.append(Tree(np.concatenate([np.array(d), more]), np.arange(len(d)), np.array(low), np.array(high), np.array(left), np.array(right), np.array(leaves), np.zeros(len(d), np.int64)))
        met |= meeting(out[-1], x, y)
        work += float(((np.unique(out[-1].route(sample)[1], return_counts=True)[1] / len(sample)) ** 2).sum())
    return out


def split(x: np.ndarray, directions: np.ndarray, share: float, spill: float = SPILL, cosine: float = COSINE) -> tuple[list, list, list, list]:
    """Borders and children of a leaf's splits from a sample of its vectors, a direction for each level, until a part holds no more
    than `share` of the sample, LEAST_SAMPLE vectors, or is dense. Children count from the leaf itself as 0; ends have -1."""
    low, high, left, right = [0.0], [0.0], [-1], [-1]
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        me, level, own = todo.pop()
        if len(own) <= max(share * len(x), 2 * LEAST_SAMPLE) or level >= len(directions):
            continue
        some = x[own[:64]]
        if ((some @ some.T)[np.triu_indices(len(some), 1)] >= cosine).mean() >= DENSE:
            continue
        at = x[own] @ directions[level]
        a, b = np.quantile(at, [0.5 - spill, 0.5 + spill])
        parts = own[at <= b], own[at >= a]
        if max(len(p) for p in parts) == len(own):
            continue
        low[me], high[me] = float(a), float(b)
        for side, part in zip((left, right), parts, strict=True):
            side[me] = len(low)
            todo.append((len(low), level + 1, part))
            for values, v in ((low, 0.0), (high, 0.0), (left, -1), (right, -1)):
                values.append(v)
    return low, high, left, right


def _leaf_sizes(forest, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit([np.asarray(v) for v in batch.column(0).to_pylist()], size)
            leaves, n = np.unique(np.concatenate([t.route(x)[1] for t in forest.value]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaves, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _leaf_samples(forest, size: int, sizes):
    """(node, vector) to a row for each large leaf whose sample takes the vector: SUBSAMPLE of its vectors, by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = (np.array(v) for v in zip(*sorted(sizes.value.items()), strict=True))
        for batch in batches:
            x = _unit([np.asarray(v) for v in batch.column(1).to_pylist()], size)
            rows, leaves = (np.concatenate(c) for c in zip(*[t.route(x) for t in forest.value], strict=True))
            at = np.minimum(np.searchsorted(numbers, leaves), len(numbers) - 1)
            dice = batch.column(0).to_numpy()[rows].view(np.uint64) % np.uint64(1 << 32) / float(1 << 32)
            take = (numbers[at] == leaves) & (dice * counts[at] < SUBSAMPLE)
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaves[take], pa.int64()), "vector": batch.column(1).take(pa.array(rows[take]))})

    return run


def _leaf_splits(forest, size: int, sizes, most: int, spill: float, cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        leaf = int(rows["leaf"].iloc[0])
        tree = next(t for t in forest.value if (t.leaf == leaf).any())
        directions = tree.directions[len(tree.directions) - LEVELS + tree.level[tree.leaf == leaf][0] :] if (tree.level[tree.leaf == leaf] < LEVELS).all() else tree.directions[:0]
        found = split(_unit(list(rows["vector"]), size), directions, most / sizes.value[leaf], spill, cosine)
        return pd.DataFrame({"leaf": [leaf], "low": [found[0]], "high": [found[1]], "left": [found[2]], "right": [found[3]]})

    return run


def refine(forest: list[Tree], classes: DataFrame, size: int, spill: float, cosine: float, done: set[int]) -> None:
    """Split leaves of more than two blocks again, by samples of their own, until none is left but dense ones (`done`).

    Every vector is routed to count the leaves, so nothing but counts and samples is shuffled; to the driver come the numbers of
    large leaves and the borders of their splits, up to NODES.
    """
    context = classes.sparkSession.sparkContext
    while sum(len(t.leaf) for t in forest) < NODES:
        sent = context.broadcast(forest)
        counted = classes.select("vector").mapInArrow(_leaf_sizes(sent, size), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * BLOCK)
        large = {r["leaf"]: r["n"] for r in counted.limit(NODES).collect() if r["leaf"] not in done}
        if not large:
            return
        sizes = context.broadcast(large)
        sampled = classes.select(F.xxhash64("node", F.lit(len(done))).alias("dice"), "vector").mapInArrow(_leaf_samples(sent, size, sizes), "leaf long, vector array<double>")
        borders = sampled.groupBy("leaf").applyInPandas(_leaf_splits(sent, size, sizes, 2 * BLOCK, spill, cosine), "leaf long, low array<double>, high array<double>, left array<int>, right array<int>")
        splits = {r["leaf"]: tuple(r[1:]) for r in borders.collect()}
        done.update(k for k in large if k not in splits or len(splits[k][0]) == 1)  # these can't be split
        number = 1 + max(int(t.leaf.max()) for t in forest)
        for t in forest:
            number = t.graft({k: v for k, v in splits.items() if len(v[0]) > 1}, number)


def grown(sample: np.ndarray, classes: DataFrame, total: int, trees: int, leaf: int, spill: float, cosine: float) -> list[Tree]:
    """The forest for all classes: fitted on the sample, large leaves split again, and more trees until hard pairs meet as often as before."""
    forest, done = fit(sample, total, trees, leaf, spill, cosine), set()
    x, y = hard_pairs(sample, cosine)
    refine(forest, classes, sample.shape[1], spill, cosine, done)
    while len(forest) > 1 and np.logical_or.reduce([meeting(t, x, y) for t in forest]).mean() < MEET and len(forest) < 10 * trees:
        more = fit(sample, total, max(1, trees // 2), leaf, spill, cosine, SEED + len(forest), 1 + max(int(t.leaf.max()) for t in forest))
        refine(more, classes, sample.shape[1], spill, cosine, done)
        forest += more
    return forest


def _routed(forest, size: int):
    """(class, copies, vector) to a row for each leaf, with all the leaves of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit([np.asarray(v) for v in part.column(2).to_pylist()], size)
                found = [t.route(x) for t in forest.value]
                rows, leaves = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((leaves, rows))
                rows, leaves = rows[order], leaves[order]
                lists = np.split(leaves, np.flatnonzero(np.diff(rows)) + 1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaves, pa.int64()), "node": part.column(0).take(take), "copies": part.column(1).take(take), "leaves": pa.array([lists[i] for i in rows], pa.list_(pa.int64())), "vector": part.column(2).take(take)})

    return run


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of i and j; labels point to the smallest index of a group."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _compare(cosine: float):
    """Links within a leaf, or between two of its blocks. A pair that shares several leaves counts in the first of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        x = _unit(list(rows["vector"]))
        node, copies = rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
        leaf, block = int(rows["leaf"].iloc[0]), rows["block"].to_numpy()
        across = rows["p"].iloc[0] != rows["q"].iloc[0]
        n = len(rows)
        links, labels = np.zeros(n, np.int64), np.arange(n)
        before = [np.asarray(v)[np.asarray(v) < leaf] for v in rows["leaves"]]
        for a in range(0, n, TILE):
            for b in range(a, n, TILE):
                near = x[a : a + TILE] @ x[b : b + TILE].T >= cosine
                if across:
                    near &= block[a : a + TILE, None] != block[None, b : b + TILE]
                if a == b:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                _hook(labels, a + i, b + j)
                ri, rj = np.unique(i), np.unique(j)
                ids = np.unique(np.concatenate([before[k] for k in [*(a + ri), *(b + rj)]]))
                if len(ids):
                    left, right = np.zeros((len(ri), len(ids)), np.float32), np.zeros((len(rj), len(ids)), np.float32)
                    for m, k in ((left, a + ri), (right, b + rj)):
                        for row, v in enumerate(k):
                            m[row, np.searchsorted(ids, before[v])] = 1
                    met = (left @ right.T) > 0
                    new = ~met[np.searchsorted(ri, i), np.searchsorted(rj, j)]
                    i, j = i[new], j[new]
                links += np.bincount(a + i, copies[b + j], n).astype(np.int64) + np.bincount(b + j, copies[a + i], n).astype(np.int64)
        keep = (links > 0) | (labels != np.arange(n))
        return pd.DataFrame({"node": node[keep], "links": links[keep], "root": node[labels[keep]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector (vec_id, embedding): other vectors of at least `cosine` that were
    found, and the smallest vec_id that links reach.

    Links are verified in double precision, so none is false; those whose ends share no leaf of any tree are missed. Equal
    vectors are one class, whose copies count. Null, empty or zero vectors and those with null or non-finite components link
    with nothing; vectors of different length never link; a repeated vec_id is another copy; an empty table gives no rows;
    other columns are ignored. The trees are fitted on at most `sample` vectors, every vector is routed and compared. Leaves of
    more than two blocks are split again by samples of their own; those that stay large, as where a dense group of vectors links
    throughout, are compared block by block, so no task holds more than two blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    valid = F.coalesce(~F.exists("vector", odd) & F.exists("vector", lambda v: v != 0), F.lit(False))
    classes = cut(rows.where(valid).groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vector-classes")
    total = classes.count()
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").collect()  # bounded by `sample`
    points = _unit([np.asarray(r["vector"]) for r in chosen])
    if total:
        forest = spark.sparkContext.broadcast(grown(points, classes, total, trees, leaf, spill, cosine))
        routed = cut(classes.select("node", "copies", "vector").mapInArrow(_routed(forest, points.shape[1]), "leaf long, node long, copies long, leaves array<long>, vector array<double>"), "leaves")
    else:
        routed = spark.createDataFrame([], "leaf long, node long, copies long, leaves array<long>, vector array<double>")
    routed = routed.withColumn("dim", F.size("vector"))
    large = routed.groupBy("leaf", "dim").count().where(F.col("count") > 2 * BLOCK).select("leaf", "dim", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = routed.join(large, ["leaf", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("leaf", "dim", "node", "copies", "leaves", "vector", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    found = cut(dealt.groupBy("leaf", "dim", "p", "q").applyInPandas(_compare(cosine), "node long, links long, root long"), "vector-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.join(linked, "node", "left").join(grouped, "node", "left")
        .select(F.col("vector").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"), "node", "copies")
    )
    # most classes have one vector, whose id they carry; only copies need a join with the vectors
    single = of_class.where("copies = 1").select(F.col("node").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    copied = rows.where(valid).join(of_class.where("copies > 1"), F.col("vector") == F.col("of")).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return single.unionByName(copied).unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
