"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, cut, small_batches, utf8
from .word_encoder import encoder

#: Tokens of a sequence; id that ends each document; bins at least this full leave the tree; groups that meet in a node of
#: the tree; pieces that a task packs at once.
CAPACITY, END_ID, NEARLY_FULL, FAN, LOCAL_ITEMS = 4096, 1, 0.995, 16, 100_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, bin_load long"


def best_fit(lengths: np.ndarray, capacity: int, loads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item, the longest first, goes to the fullest bin that still takes it.

    loads: bins that are there already. Returns the bin and the offset of each item, and the loads of all bins. Open bins are
    kept by free space; a bit set of the free spaces in use finds the smallest that is large enough. Ties: the earlier item
    and the bin that got its free space last. Items longer than capacity or below 1 are errors of the caller.
    """
    load = [] if loads is None else loads.tolist()
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_set = 0
    for b, x in enumerate(load):
        if x < capacity:
            by_free[capacity - x].append(b)
            free_set |= 1 << (capacity - x)
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_set &= ~(1 << free)
        else:
            free, b = capacity, len(load)
            load.append(0)
        bins[i], places[i] = b, load[b]
        load[b] += n
        if free > n:
            by_free[free - n].append(b)
            free_set |= 1 << (free - n)
    return bins, places, np.array(load, np.int64)


def _pieces(path: str, capacity: int, end_id: int):
    """Arrow batches of (doc_id, text) to packed pieces, one local round for each LOCAL_ITEMS pieces of the partition."""

    def packed(rows: list[tuple], block: int) -> pa.RecordBatch:
        doc, *numbers = zip(*rows, strict=True)
        piece, start, length, crc = (np.array(x, np.int64) for x in numbers)
        bins, places, loads = best_fit(length, capacity)
        columns = {"doc_id": pa.array(doc, pa.int64()), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc, "bin": (block << 24) + bins, "place": places, "bin_load": loads[bins]}
        return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        block = TaskContext.get().partitionId() << 14
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for part in blocks(texts):
                ids, counts = encoder(path).encode(texts[part])
                ids, at = ids.astype("<u4"), 0
                for doc, n in zip(docs[part], counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        cut_ids = own[s : s + capacity]
                        rows.append((doc, k, s, len(cut_ids), zlib.crc32(cut_ids.tobytes())))
                while len(rows) >= LOCAL_ITEMS:
                    yield packed(rows[:LOCAL_ITEMS], block)
                    rows, block = rows[LOCAL_ITEMS:], block + 1
        if rows:
            yield packed(rows, block)

    return run


def _merge(capacity: int, nearly_full: int, fan: int):
    """One node of the tree: underfull bins of up to `fan` groups are packed as items.

    A row is a bin of the first round; rows of one `top` share a sequence already. Bins that stay underfull go on: those up to
    half full (at most one, after best fit) and the `fan` emptiest others, as many as the bins from sibling groups can use;
    the rest are sequences as they are.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tops = rows.groupby("top", sort=True)["load"].sum()
        bins, places, loads = best_fit(tops.to_numpy(np.int64), capacity)
        order = np.argsort(loads, kind="stable")
        open_bins = order[loads[order] < nearly_full]
        light = int((loads[open_bins] * 2 <= capacity).sum())
        goes_on = np.zeros(len(loads), bool)
        goes_on[open_bins[: light + fan]] = True
        first = np.full(len(loads), -1, np.int64)
        names = tops.index.to_numpy(np.int64)
        for i in range(len(names) - 1, -1, -1):
            first[bins[i]] = names[i]
        at = pd.Series(np.arange(len(names)), index=names).reindex(rows["top"]).to_numpy()
        return pd.DataFrame({"bin": rows["bin"], "top": first[bins[at]], "base": rows["base"].to_numpy() + places[at], "load": rows["load"], "node": rows["node"], "open": goes_on[bins[at]]})

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, nearly_full: float = NEARLY_FULL, fan: int = FAN) -> DataFrame:
    """Pack the documents' ids into as few sequences of at most `capacity` ids as best fit finds.

    docs: doc_id and text; other columns are ignored. Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset,
    one row for each piece. Null and empty texts give a piece of the end id alone. Documents longer than `capacity` are cut
    into pieces of that length, the last may be shorter; repeated doc_ids, and rows without one, are packed each by itself; an empty table gives no
    rows; ties in length go by the order of rows.

    First round: each task encodes its rows and packs the lengths best-fit. Nearly full bins are sequences. The others are
    items of further rounds: `fan` neighbouring groups meet in a node, which packs their bins and hands on what is still
    underfull, up to a root. A node gets at most fan * (fan + 1) bins or so, whatever the size of the corpus.
    """
    enough = int(np.ceil(capacity * nearly_full))
    pieces = cut(small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer_path, capacity, end_id), _PIECES), "pieces")
    bins = pieces.where("place = 0").select("bin", F.col("bin").alias("top"), F.lit(0).cast("long").alias("base"), F.col("bin_load").alias("load"), F.shiftright("bin", 24).alias("block"))
    parts = pieces.select(F.shiftright("bin", 38).alias("part")).agg(F.max("part")).first()[0]
    schema = "bin long, top long, base long, load long, node long, open boolean"
    merge = _merge(capacity, enough, fan)
    # the blocks of a partition meet first (node: the partition), then neighbouring partitions
    level = cut(bins.where(F.col("load") < enough).withColumn("node", F.shiftright("block", 14)).drop("block").groupBy("node").applyInPandas(merge, schema), "packing")
    closed = [level.where("not open")]
    span = 1
    while parts is not None and span <= parts:
        span *= fan
        nodes = level.where("open").select("bin", "top", "base", "load", F.floor(F.col("node") / fan).cast("long").alias("node"))
        level = cut(nodes.groupBy("node").applyInPandas(merge, schema), "packing")
        closed.append(level.where("not open"))
    placed = level.where("open")
    for x in closed:
        placed = placed.unionByName(x)
    placed = placed.select(F.col("bin").alias("of"), "top", "base")
    joined = pieces.join(placed, pieces["bin"] == placed["of"], "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("top", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("base", F.lit(0))).cast("long").alias("offset"),
    )
