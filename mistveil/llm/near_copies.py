"""Near copies for the pipeline: SimHash and min-hash candidates over 5-word shingles, each verified by its Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import Scratch, fresh, small, small_batches, utf8

#: Words of a shingle, and least Jaccard similarity of two texts' sets of shingles that links them.
WORDS, SHARE = 5, 0.8
#: Bands and min-hashes of a band: two texts at SHARE agree in a band with 1 - (1 - 0.8**4)**16 = 0.9998.
BANDS, ROWS = 16, 4

_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set of shingle hashes; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 13):
        np.minimum(least, ((own[at : at + (1 << 13)] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    keys = ((least >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
    return ((keys ^ (keys >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        prints, sets, sizes, keys = [], [], [], []
        for t in utf8(batch.column(1)):
            hashes = simhash.shingles(t, WORDS, simhash.SEED)
            own = np.unique(hashes)
            prints.append(simhash._majority(hashes) if len(hashes) else 0)
            sets.append(xxh64_intdigest(own.tobytes()))
            sizes.append(len(own))
            keys.append(bands(own))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, sets)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": longs[0], "own": longs[1], "n": pa.array(sizes, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64()))})


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last = [], (None, None)
        for x, y in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
            if x != last[0]:
                last = (x, np.unique(simhash.shingles(x, WORDS, simhash.SEED)))
            other = np.unique(simhash.shingles(y, WORDS, simhash.SEED))
            both = len(np.intersect1d(last[1], other, assume_unique=True))
            keep.append(both >= SHARE * (len(last[1]) + len(other) - both) - 1e-9)
        yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep, pa.bool_()))


def _verified(scratch: Scratch, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b: doc_id) whose texts have SHARE of their shingles in common."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    left, right = texts.toDF("a", "x"), texts.toDF("b", "y")
    return scratch.cut(small_batches(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")).mapInArrow(_similar, "a long, b long"), "similar")


def _sizes_fit(n: str, m: str):
    """Sets of these sizes can reach SHARE."""
    return F.least(n, m) >= SHARE * F.greatest(n, m) - 1e-9


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of SHARE or more reach.

    Texts of equal shingle sets are one class; texts without a word belong together. Candidates are classes whose SimHash
    fingerprints differ by simhash.DISTANCE bits at most (near-identical texts), and those that share a band (texts at 0.8 differ
    by about 10 of 64 bits, which no segment index reaches). A band's members are first verified against the smallest of them;
    then all pairs of a band that are still in different components are, so a large group costs no pairs by its square, and no
    candidate is left out.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(scratch.cut(_near_copies(scratch, docs), "near-copies"))


def _near_copies(scratch: Scratch, docs: DataFrame) -> DataFrame:
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = scratch.cut(rows.mapInArrow(_marks, "doc_id long, fp long, own long, n long, bands array<long>"), "marks")
    classes = scratch.cut(marks.groupBy("own", "n").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("many")).where("many > 1")
    members = scratch.cut(keyed.join(shared, "key").select("key", "node", "n", F.col("least.node").alias("first"), F.col("least.n").alias("first_n")), "members")
    star = members.where((F.col("node") != F.col("first")) & _sizes_fit("n", "first_n"))
    close = _close_prints(scratch, classes)
    tried = scratch.cut(star.select(F.col("first").alias("a"), F.col("node").alias("b")).unionByName(close).distinct(), "tried")
    found = _verified(scratch, tried, docs)
    label = components(found)
    placed = scratch.cut(members.select("key", "node", "n").join(label, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("of")), "placed")
    mixed = placed.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("key")
    open_ = scratch.cut(placed.join(mixed, "key"), "open")
    other = open_.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("of").alias("of2"))
    across = open_.join(other, "key").where((F.col("of") < F.col("of2")) & _sizes_fit("n", "n2"))
    pairs = across.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _verified(scratch, scratch.cut(pairs, "pairs"), docs)
    grouped = components(found.unionByName(more))
    of_class = classes.join(grouped, "node", "left").select("own", "n", F.coalesce("component", "node").alias("component_id"))
    return marks.join(of_class, ["own", "n"]).select("doc_id", "component_id")


def _close_prints(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """a, b: the smallest classes of fingerprints within simhash.DISTANCE, and those of one fingerprint with the smallest of it."""
    prints = scratch.cut(classes.where("n > 0").groupBy("fp").agg(F.min("node").alias("node")), "prints")
    equal = classes.where("n > 0").join(prints.select("fp", F.col("node").alias("first")), "fp").where("node <> first")
    links = simhash.links(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.unionByName(equal.select(F.col("first").alias("a"), F.col("node").alias("b")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without those that link to a smaller doc_id, directly or over others; all columns stay.

    Rows that share a doc_id stay or go together; rows without one stay. An empty table gives no rows.
    """
    name = fresh(docs, "__gone")
    gone = near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(small(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti")
