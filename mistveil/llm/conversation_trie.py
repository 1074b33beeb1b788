"""Prefix trie of conversations: nodes in preorder, subtrees as intervals, leaves and savings by differences of prefix sums.

Distinct sequences of turns are ranked lexicographically. All sequences below a node follow each other in that order, so a node's
members are an interval of ranks, and nodes sorted by (first rank, depth) stand in preorder: what a node's subtree holds is a
running total at the end of its last sequence less the running total before the node. No step goes level by level, and no task
sees a whole conversation: a sequence longer than BLOCK turns is ranked by blocks, then by the ranks of its blocks, and so on.
A prefix is named by 128 bits that all its turns and their places go into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix_sums import in_order
from .shared import Scratch, small

#: Turns of a conversation that a task puts in order at once.
BLOCK = 256
#: Conversations whose numbers are equal but for the remainder by FAMILY (which has the sign of the number) share their beginning; at most HEADS - 1 turns of it.
FAMILY, HEADS = 20, 4
_KEY = ["depth", "p1", "p2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, s1, s2 (128 bits of role and text) and words of each row; null role or text becomes empty, rows without conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.xxhash64(role, text).alias("s1"), F.xxhash64(F.lit(1), text, role).alias("s2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def numbered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns with k (place in their conversation, from 1), and one row for each conversation: conv, n."""
    rows = in_order(turns, scratch, "turns", [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("s1"), F.col("s2")])
    convs = scratch.cut(rows.groupBy("conv").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "conversations")
    return rows.join(small(convs.drop("n")), "conv").withColumn("k", F.col("pos") - F.col("first") + 1).select("conv", "k", "s1", "s2", "words"), convs.drop("first")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """conv, i (from 1), s1, s2, words of the rebuilt conversations, and a row for each of them (conv), also where no turn is left.

    A conversation begins with the first h turns of the one that heads its family (all it has, none if there is none), then come its own after the first h.
    """
    rows, convs = numbered(turns, scratch)
    base = F.col("conv") - F.col("conv") % FAMILY
    heads = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = convs.withColumn("base", base).join(small(heads), "base", "left").select(
        "conv", "base", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"), F.coalesce("n_base", F.lit(0)).alias("n_base")
    )
    plan = scratch.cut(plan.withColumn("taken", F.least("h", "n_base")), "rebuilding")
    first = rows.where(F.col("k") < HEADS).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "taken"), "base").where("k <= taken")
    own = rows.join(small(plan.select("conv", "h", "taken")), "conv").where("k > h").withColumn("k", F.col("taken") + F.col("k") - F.col("h"))
    out = [x.select("conv", F.col("k").alias("i"), "s1", "s2", "words") for x in (first, own)]
    return scratch.cut(out[0].unionByName(out[1]), "rebuilt"), plan.select("conv")


def _block(i: str = "i") -> Column:
    return F.floor((F.col(i) - 1) / BLOCK)


def _running(rows: DataFrame, longest: int) -> DataFrame:
    """rows (conv, i, h1, h2, ...) with p1 and p2: all h up to each place, combined by exclusive or. Windows hold BLOCK rows at most."""
    within = Window.partitionBy("conv", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", _block())
    out = rows.select("*", F.bit_xor("h1").over(within).alias("p1"), F.bit_xor("h2").over(within).alias("p2"))
    if longest <= BLOCK:
        return out.drop("block")
    sums = rows.groupBy("conv", (F.col("block") + 1).alias("i")).agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    before = _running(sums, -(-longest // BLOCK)).select("conv", F.col("i").alias("block"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    out = out.join(before, ["conv", "block"], "left")
    for p, b in (("p1", "b1"), ("p2", "b2")):
        out = out.withColumn(p, F.col(p).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))))
    return out.drop("block", "b1", "b2")


def _ranked(rows: DataFrame, sequences: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """sequences (conv, ...) with `rank`: the place of each in lexicographic order of its turns in rows (conv, i, symbol: array<long>).

    Blocks of turns become arrays; as long as a sequence has several, these are replaced by their ranks among all different ones.
    """
    entries = F.transform(F.sort_array(F.collect_list(F.struct("i", "symbol"))), lambda x: x["symbol"])
    blocks = rows.groupBy("conv", (_block() + 1).alias("i")).agg(F.flatten(entries).alias("symbols"))
    while longest > BLOCK:
        blocks = scratch.cut(blocks, "blocks")
        ranks = in_order(blocks.select("symbols").distinct(), scratch, "block-ranks", [F.col("symbols")], "rank")
        rows = blocks.join(small(ranks), "symbols").select("conv", "i", F.array("rank").alias("symbol"))
        blocks = rows.groupBy("conv", (_block() + 1).alias("i")).agg(F.flatten(entries).alias("symbols"))
        longest = -(-longest // BLOCK)
    keyed = sequences.join(blocks.select("conv", "symbols"), "conv", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<long>")))
    return in_order(keyed, scratch, "sequences", [F.col("symbols")], "rank").drop("symbols")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ascending, comma-joined numbers of each group of rows (depth, p1, p2, conv); groups stream through."""
    key, state = None, hashlib.sha256()

    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], [*k, d], strict=True)) for k, d in done], pa.schema([*((c, pa.int64()) for c in _KEY), ("ends_sha256", pa.string())]))

    for batch in batches:
        done = []
        for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256(b"%d" % conv)
            else:
                state.update(b",%d" % conv)
        yield rows(done)
    if key is not None:
        yield rows([(key, state.hexdigest())])


def prefix_trie(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations (see rebuilt), from the empty one on:

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and position and subtree_end: the
    node's place in preorder and that after its subtree.

    Rows of conversations (conv_id, turn, role, text) are ordered by turn, null first, ties by role, then in a fixed order of
    their texts; equal rows are turns each. Rows without conv_id are left out; other columns are not read. An empty table gives
    no rows. The result reads tables of `scratch`.
    """
    rows, convs = rebuilt(_turns(conversations), scratch)
    longest = rows.agg(F.max("i")).first()[0] or 0
    place = rows.select("*", F.xxhash64("i", "s1", "s2").alias("h1"), F.xxhash64("s2", "i", "s1").alias("h2"))
    named = scratch.cut(_running(place, longest), "prefixes")

    last = named.groupBy("conv").agg(F.max(F.struct("i", "p1", "p2")).alias("end"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv", "left").select("conv", *(F.coalesce(f"end.{x}", zero).alias(y) for x, y in (("i", "depth"), ("p1", "p1"), ("p2", "p2"))))
    ends = scratch.cut(ends, "ends")
    sequences = scratch.cut(ends.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.min("conv").alias("conv")).select("conv", "copies"), "distinct")
    distinct = scratch.cut(named.join(small(sequences.select("conv")), "conv", "left_semi"), "distinct-prefixes")
    ranked = _ranked(distinct.select("conv", "i", F.array("s1", "s2").alias("symbol")), sequences, longest, scratch)

    root = [zero.alias(c) for c in ("p1", "p2", "q1", "q2", "words")]
    steps = distinct.join(small(ranked), "conv").select(
        "conv", "copies", "rank", F.col("i").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "words"
    ).unionByName(ranked.select("conv", "copies", "rank", zero.alias("depth"), *root))
    nodes = steps.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words")
    )
    nodes = scratch.cut(nodes, "nodes")
    scratch.drop(named, distinct)

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    digests = ends.select(*_KEY, "conv").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")
    nodes = nodes.join(children, _KEY, "left").join(digests, _KEY, "left").join(small(parents), ["depth", "q1", "q2"], "left").select(
        "depth", "conv_id", "n_convs", "first", "last", F.coalesce("n_children", zero).alias("n_children"), F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    placed = scratch.cut(in_order(nodes, scratch, "preorder", [F.col("first"), F.col("depth")], "position", {"leaves_before": "leaf", "saved_before": "saved"}), "placed")
    # Every sequence is the first of its own deepest node, which stands last among those that it is the first of.
    stops = placed.groupBy(F.col("first").alias("last")).agg(
        (F.max("position") + 1).alias("subtree_end"), F.max(F.col("leaves_before") + F.col("leaf")).alias("leaves_to"), F.max(F.col("saved_before") + F.col("saved")).alias("saved_to")
    )
    return placed.join(small(scratch.cut(stops, "subtree-ends")), "last").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_to") - F.col("leaves_before")).alias("n_leaves"),
        (F.col("saved_to") - F.col("saved_before")).alias("saved_tokens"), "ends_sha256", "position", "subtree_end",
    )


def digest(conversations: DataFrame) -> DataFrame:
    """The trie's rows without their places in preorder, written; everything else that led to them is deleted."""
    with Scratch(conversations.sparkSession) as scratch:
        return scratch.keep(scratch.cut(prefix_trie(conversations, scratch).drop("position", "subtree_end"), "trie"))


#: The same rows in DuckDB, by lists of turns as keys. CRC-32 goes over the digits of a number, bit by bit, with its reflected polynomial.
SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (
  SELECT n.c, coalesce(b.n, 0) AS nb, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(n.c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 4 AS h
  FROM n LEFT JOIN n AS b ON b.c = n.c - n.c % 20
), r AS (
  SELECT h.c, t.k AS i, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.k <= h.h
  UNION ALL SELECT h.c, least(h.h, h.nb) + t.k - h.h, role, text FROM h JOIN t ON t.c = h.c AND t.k > h.h
), p AS (
  SELECT h.c, coalesce(any_value(l.turns), []) AS turns FROM h LEFT JOIN (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS turns FROM r GROUP BY c) l ON l.c = h.c GROUP BY h.c
), m AS (SELECT c, turns[1:d] AS turns, d, len(turns) = d AS here FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM p)),
node AS (
  SELECT turns, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE here), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM m GROUP BY turns, d
), kids AS (SELECT turns[1:d - 1] AS turns, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.turns = node.turns AND kids.d = node.d),
sub AS (
  SELECT turns[1:a] AS turns, a AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_node) GROUP BY ALL
)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM full_node x JOIN sub s ON s.turns = x.turns AND s.d = x.d LEFT JOIN node y ON x.d > 0 AND y.d = x.d - 1 AND y.turns = x.turns[1:x.d - 1]
"""
