"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Rounds after which something must be wrong: each round at least halves the longest path.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to the smallest node among it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    moved = down.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).where("a <> b")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of `edges` (columns a, b: long) reaches.

    Nodes without edges don't come back. Loops and repeated edges are allowed, null ends are dropped, an empty table gives no
    rows. Edges stay distributed: only a count and a checksum of each round reach the driver. Each round is written to the
    shared folder, so a lost executor repeats one round at most, and the round before it is deleted; the result reads the last one.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        before, now = now, scratch.cut(_small_star(_large_star(now).distinct()).distinct(), "edges")
        last, mark = mark, _mark(now)
        scratch.drop(before)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
