"""Repeated byte strings of a corpus: blockwise suffix grouping with a difference-cover sample.

A position is *repeated* if the LENGTH bytes from it also start earlier (earlier document, or earlier in its own). Every byte that such
a string covers is removed. Three passes, none of which holds more than one chunk of text or one bucket of suffixes in a task:

1. Cover sample. Of each document only the offsets whose remainder by PERIOD is in COVER are named, by their LENGTH - PERIOD + 1 bytes. Any two
   remainders have a common shift below PERIOD that takes both into COVER, so two equal strings of LENGTH bytes always hold a
   pair of equal samples at the same shift: a suffix without a sample that occurs twice is settled by these ranks alone.
2. Suffix buckets. The other suffixes are bucketed by their first bytes, and one range of buckets is sorted at a time; its shuffle files are
   deleted before the next one. How many ranges there are follows from the bytes, so that disk stays a fixed share of the text.
3. The runs of repeated positions are cut out of the texts.

Suffixes travel as packed arrays of keys, one block for each chunk of text and bucket, and each chunk sends a key once (later ones of the
same chunk are repeated in any case). So a string that a third of the corpus holds has one entry a chunk. Answers come back as
one bit for each key in the same order, and are matched with positions by computing the chunk's keys again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small_batches

#: Bytes of a repeated string.
LENGTH = 100
#: A perfect difference set: each remainder by PERIOD is the difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text whose suffixes a task holds at once, suffixes of a bucket, bytes of text for each file.
CHUNK_BYTES, BUCKET, FILE_BYTES = 4 << 20, 2_000_000, 128 << 20
#: Most bytes of keys that are shuffled at once, as a share of the bytes of text.
SHARE = 0.8

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TEXTS = "chunk long, at int, last boolean, row long, doc_id long, piece int, pieces int, start long, own long, data binary"
_BLOCKS = "chunk long, bucket int, data binary"
_REGIONS = "chunk long, at int, last boolean, place int, start long, own long, data binary"
_RUNS = "chunk long, place int, data binary"
_CUT = "row long, doc_id long, piece int, pieces int, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


@dataclass(frozen=True)
class Sizes:
    """Length of strings and the bounds of what a task holds."""

    length: int = LENGTH
    chunk: int = CHUNK_BYTES
    bucket: int = BUCKET
    share: float = SHARE

    @property
    def named(self) -> int:
        """Bytes of a sample: as many as any string of `length` bytes has after the shift that takes it into the cover."""
        return self.length - PERIOD + 1


def _mix(pos: np.ndarray, words: np.ndarray, length: int, lane: int) -> np.ndarray:
    """64 bits for the `length` bytes from each position."""
    m, h = _MULTIPLIERS[lane], np.full(len(pos), lane + 1, np.uint64)
    for o in [*range(0, length - 8, 8), length - 8]:
        h ^= words[o:][pos]
        h *= m
        h ^= h >> np.uint64(29)
    return h


def _mix_both(pos: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """_mix of both lanes; the words are read once."""
    (m, n), h, g = _MULTIPLIERS, np.full(len(pos), 1, np.uint64), np.full(len(pos), 2, np.uint64)
    for o in [*range(0, length - 8, 8), length - 8]:
        w = words[o:][pos]
        h ^= w
        h *= m
        h ^= h >> np.uint64(29)
        g ^= w
        g *= n
        g ^= g >> np.uint64(29)
    return h, g


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from each position, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def _bounds(n: int) -> np.ndarray:
    """Where each of n equal parts of the 64-bit numbers ends."""
    return np.array([min((i * (1 << 64)) // n, (1 << 64) - 1) for i in range(1, n)], np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each chunk, which follow each other in the order of `at`."""
    chunk, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != chunk:
                if rows:
                    raise RuntimeError("a chunk was read in parts")
                chunk = r["chunk"]
            if r["at"] != len(rows):
                raise RuntimeError("a chunk was read out of order")
            rows.append(r)
            if r["last"]:
                yield chunk, rows
                rows = []
    if rows:
        raise RuntimeError("a chunk was read in parts")


def _split(sizes: Sizes):
    """Documents in order, cut into chunks; a document beyond a chunk is cut into pieces that overlap by length - 1 bytes."""
    step = max(PERIOD, sizes.chunk // PERIOD * PERIOD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, n_row, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def done() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + chunk] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([i == len(rows) - 1 for i in range(len(rows))]),
                 *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True))],
                names=["chunk", "at", "last", "row", "doc_id", "piece", "pieces", "start", "own", "data"],
            )

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                pieces = max(1, -(-len(data) // step))
                for piece in range(pieces):
                    start = piece * step
                    own = min(step, len(data) - start)
                    if rows and size + own > sizes.chunk:
                        yield done()
                        chunk, rows, size = chunk + 1, [], 0
                    rows.append(((part << 32) + n_row, doc_id, piece, pieces, start, own, data[start : start + own + sizes.length - 1]))
                    size += own
                n_row += 1
        if rows:
            yield done()

    return run


def _sample_positions(rows: list[dict], sizes: Sizes, cover: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chunk's bytes and the positions of its samples (pieces start at multiples of PERIOD)."""
    out, at = [np.zeros(0, np.int64)], 0
    for r in rows:
        n = len(r["data"])
        if n >= sizes.named:
            out.append(cover[: np.searchsorted(cover, n - sizes.named + 1)] + at)
        at += n
    return b"".join(r["data"] for r in rows), np.concatenate(out)


def _cover(sizes: Sizes) -> np.ndarray:
    at = np.arange(sizes.chunk + sizes.length + PERIOD)
    return at[np.isin(at % PERIOD, COVER)]


def _block_rows(chunks: list[int], buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "bucket", "data"])


def _sample_blocks(sizes: Sizes, n_buckets: int, turn: int, turns: int):
    """Names of the samples of a chunk in buckets turn/turns .. (turn + 1)/turns of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, ends = _cover(sizes), _bounds(n_buckets)
        low, high = turn * n_buckets // turns, (turn + 1) * n_buckets // turns
        for chunk, rows in _chunks(batches):
            data, pos = _sample_positions(rows, sizes, cover)
            keys = _mix(pos, _words(data), sizes.named, 0)
            chosen = np.ones(len(keys), bool) if low == 0 else keys >= ends[low - 1]
            keys = np.unique(keys[chosen if high == n_buckets else chosen & (keys < ends[high - 1])])
            cuts = [0, *np.searchsorted(keys, ends, "left").tolist(), len(keys)]
            used = [b for b in range(low, high) if cuts[b] < cuts[b + 1]]
            yield _block_rows([chunk] * len(used), used, [keys[cuts[b] : cuts[b + 1]].tobytes() for b in used])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """The blocks of each bucket, in the order of their chunks."""
    bucket, chunks, data = None, [], []
    for batch in batches:
        for c, b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != bucket and chunks:
                yield bucket, chunks, data
                chunks, data = [], []
            bucket = b
            chunks.append(c)
            data.append(d.as_py())
    if chunks:
        yield bucket, chunks, data


def _answers(judge: Callable[[list[bytes]], np.ndarray], width: int):
    """Bits of each block: judge gives one truth value for each key of the bucket, in the order given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks, data in _buckets(batches):
            marks, at, bits = judge(data), 0, []
            for d in data:
                n = len(d) // width
                bits.append(np.packbits(marks[at : at + n]).tobytes())
                at += n
            yield _block_rows(chunks, [bucket] * len(chunks), bits)

    return run


def _met_twice(data: list[bytes]) -> np.ndarray:
    """Samples whose name another chunk has too."""
    keys = np.frombuffer(b"".join(data), np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


_SUFFIX = np.dtype([("key", "<u8"), ("check", "<u4")])


def _sorted_keys(first: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys in two parts: an order that sorts them (equal ones in any order), which of them in that order differ from the one before, and the first place of each distinct one."""
    order = np.argsort(first)
    a, b = first[order], check[order]
    same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & other).any():  # equal in 64 bits of 96: rank by all of them
        order = np.lexsort((check, first))
        a, b = first[order], check[order]
        same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    new = np.ones(len(order), bool)
    new[1:] = ~same | other
    return order, new, np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order


def _not_first(data: list[bytes]) -> np.ndarray:
    """Suffixes that an earlier chunk has too."""
    keys = np.frombuffer(b"".join(data), _SUFFIX)
    _, _, firsts = _sorted_keys(np.ascontiguousarray(keys["key"]), keys["check"])
    out = np.ones(len(keys), bool)
    out[firsts] = False
    return out


def _bits(parts: list[bytes], counts: list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool) for p, n in zip(parts, counts, strict=True))])


def _with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, bytes], list[dict]]]:
    """For each chunk its answers by bucket and its rows; answers (kind 0) come first."""
    chunk, answers, rows = None, {}, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != chunk:
                if rows:
                    yield chunk, answers, rows
                chunk, answers, rows = r["chunk"], {}, []
            if r["kind"] == 0:
                answers[r["at"]] = r["data"]
            else:
                rows.append(r)
    if rows:
        yield chunk, answers, rows


def _candidates(sizes: Sizes, n_buckets: int):
    """The stretches of each piece whose suffixes hold a sample that occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, ends = _cover(sizes), _bounds(n_buckets)
        for chunk, answers, rows in _with_answers(batches):
            data, pos = _sample_positions(rows, sizes, cover)
            keys, inverse, counts = np.unique(_mix(pos, _words(data), sizes.named, 0), return_inverse=True, return_counts=True)
            cuts = [0, *np.searchsorted(keys, ends, "left").tolist(), len(keys)]
            used = [b for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
            twice = _bits([answers[b] for b in used], [cuts[b + 1] - cuts[b] for b in used]) | (counts > 1)
            hits = pos[twice[inverse]]
            out, at = [], 0
            for place, r in enumerate(rows):
                n = len(r["data"])
                own = hits[np.searchsorted(hits, at) : np.searchsorted(hits, at + n)] - at
                last = min(r["own"], n - sizes.length + 1)  # positions before it have a whole string
                if len(own) and last > 0:
                    gaps = np.nonzero(np.diff(own) > PERIOD)[0]
                    for a, b in zip(own[np.r_[0, gaps + 1]].tolist(), own[np.r_[gaps, len(own) - 1]].tolist(), strict=True):
                        a, b = max(0, a - PERIOD + 1), min(last, b + 1)
                        if a < b:
                            out.append((place, r["start"] + a, b - a, r["data"][a : b + sizes.length - 1]))
                at += n
            if out:
                places, starts, owns, datas = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array([i == len(out) - 1 for i in range(len(out))]), pa.array(places, pa.int32()),
                     pa.array(starts, pa.int64()), pa.array(owns, pa.int64()), pa.array(datas, pa.binary())],
                    names=["chunk", "at", "last", "place", "start", "own", "data"],
                )

    return run


def _suffixes(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, positions of the suffixes of a chunk's stretches, and a number from the first 16 bytes of each, which says when it is sorted."""
    words, out, at = _words(b"".join(r["data"] for r in rows)), [np.zeros(0, np.int64)], 0
    for r in rows:
        out.append(np.arange(at, at + r["own"]))
        at += len(r["data"])
    pos = np.concatenate(out)
    return words, pos, _mix(pos, words, 16, 1) >> np.uint64(32)


def _turn(words, pos, first, turn: int, turns: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffixes whose turn it is: positions, distinct keys in order, each position's key, and the first position of each key."""
    chosen = pos[(first * np.uint64(turns)) >> np.uint64(32) == turn]
    key, check = _mix_both(chosen, words, sizes.length)
    check = (check >> np.uint64(32)).astype("<u4")
    order, new, firsts = _sorted_keys(key, check)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    distinct = np.empty(len(firsts), _SUFFIX)
    distinct["key"], distinct["check"] = key[firsts], check[firsts]
    return chosen, distinct, number, firsts


def _suffix_blocks(sizes: Sizes, n_buckets: int, turn: int, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _bounds(n_buckets)
        for chunk, rows in _chunks(batches):
            words, pos, first = _suffixes(rows)
            _, keys, _, _ = _turn(words, pos, first, turn, turns, sizes)
            cuts = [0, *np.searchsorted(keys["key"], ends).tolist(), len(keys)]
            used = [b for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
            yield _block_rows([chunk] * len(used), [turn * n_buckets + b for b in used], [keys[cuts[b] : cuts[b + 1]].tobytes() for b in used])

    return run


def _repeated(sizes: Sizes, n_buckets: int, turns: int):
    """Runs of repeated positions of each piece, as offsets in the document: first and one past the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _bounds(n_buckets)
        for chunk, answers, rows in _with_answers(batches):
            words, pos, first = _suffixes(rows)
            marked = np.zeros(sum(len(r["data"]) for r in rows) + 1, bool)
            for turn in range(turns):
                chosen, keys, number, firsts = _turn(words, pos, first, turn, turns, sizes)
                cuts = [0, *np.searchsorted(keys["key"], ends).tolist(), len(keys)]
                used = [b for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
                later = _bits([answers[turn * n_buckets + b] for b in used], [cuts[b + 1] - cuts[b] for b in used])
                again = np.ones(len(chosen), bool)
                again[firsts] = False  # the first of the chunk is repeated only where an earlier chunk has it
                marked[chosen] = again | later[number]
            out, at = {}, 0
            for r in rows:
                edges = np.flatnonzero(np.diff(np.r_[False, marked[at : at + r["own"]], False]))
                if len(edges):
                    out.setdefault(r["place"], []).append(edges + r["start"])
                at += len(r["data"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), pa.array(list(out), pa.int32()), pa.array([np.concatenate(x).astype("<i8").tobytes() for x in out.values()], pa.binary())], names=["chunk", "place", "data"])

    return run


def _covered(runs: bytes | None, length: int) -> list[tuple[int, int]]:
    """The stretches of bytes that the strings from runs of positions cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in np.frombuffer(runs or b"", "<i8").reshape(-1, 2).tolist():
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keep(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _apply(length: int):
    """Whole documents with their spans cut out. A piece of a longer one keeps its own bytes, with the spans it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("n_bytes", pa.int64()),
                            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        key, runs = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    key, runs = (r["chunk"], r["at"]), r["data"]
                    continue
                spans = _covered(runs if key == (r["chunk"], r["at"]) else None, length)
                data = r["data"][: r["own"]]
                kept = _keep(data, spans) if r["pieces"] == 1 else data
                out.append({"row": r["row"], "doc_id": r["doc_id"], "piece": r["piece"], "pieces": r["pieces"], "n_bytes": r["own"], "spans": [{"start": a, "end": b} for a, b in spans], "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _join_pieces(table: pa.Table) -> pa.Table:
    """A document of several pieces: spans that run on into the next piece are joined before they are cut."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    spans: list[tuple[int, int]] = []
    for s in (s for r in rows for s in r["spans"]):
        if spans and s["start"] <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], s["end"]))
        else:
            spans.append((s["start"], s["end"]))
    data = b"".join(r["kept"] for r in rows)
    done = rows[0] | {"pieces": 1, "n_bytes": len(data), "spans": [{"start": a, "end": b} for a, b in spans], "kept": _keep(data, spans)}
    return pa.Table.from_pylist([done], table.schema)


def deduplicate(docs: DataFrame, scratch: Scratch, sizes: Sizes | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start and end, in bytes, of what is removed) and kept (the remaining bytes) of every row of docs (doc_id, text).

    Documents are ordered by doc_id (null first), rows that share one by their text's hash and text; of equal rows one counts as the first.
    Null and empty texts have no bytes. An empty table gives no rows; other columns are not read. What remains need not be valid
    UTF-8, as strings are of bytes. The result reads tables of `scratch`, which its owner deletes.
    """
    sizes = sizes or Sizes()
    if sizes.length < PERIOD + 8:
        raise ValueError(f"strings have {PERIOD + 8} bytes or more")
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    n_bytes = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n_files = max(2 * cores, -(-n_bytes // FILE_BYTES))
    ordered = rows.withColumn("tie", F.xxhash64("data")).repartitionByRange(n_files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "data").drop("tie")
    texts = scratch.cut(ordered.mapInArrow(_split(sizes), _TEXTS), "texts", one_group=True)

    n_samples = n_bytes * len(COVER) // PERIOD
    turns = max(1, -(-n_samples * 8 // max(1, int(sizes.share * n_bytes))))
    n_buckets = turns * max(2 * cores, -(-n_samples // (sizes.bucket * turns)))
    marks = _rounds(texts, scratch, "sample-marks", turns, n_buckets // turns, lambda turn: _sample_blocks(sizes, n_buckets, turn, turns), _answers(_met_twice, 8))
    regions = scratch.cut(_by_chunk(texts, marks, n_files).mapInArrow(_candidates(sizes, n_buckets), _REGIONS), "suffix-stretches", one_group=True)
    scratch.drop(marks)

    n_suffixes = regions.agg(F.sum("own")).first()[0] or 0
    turns = max(1, -(-n_suffixes * _SUFFIX.itemsize // max(1, int(sizes.share * n_bytes))))
    n_buckets = max(2 * cores, -(-n_suffixes // (sizes.bucket * turns)))
    marks = _rounds(regions, scratch, "suffix-marks", turns, n_buckets, lambda turn: _suffix_blocks(sizes, n_buckets, turn, turns), _answers(_not_first, _SUFFIX.itemsize))
    runs = scratch.cut(_by_chunk(regions, marks, n_files).mapInArrow(_repeated(sizes, n_buckets, turns), _RUNS), "runs")
    scratch.drop(marks, regions)

    named = runs.withColumnRenamed("place", "bucket")
    pieces = _by_chunk(texts, named, n_files, "at", "kind").mapInArrow(_apply(sizes.length), _CUT)
    whole = pieces.where("pieces = 1")
    if texts.where("pieces > 1").limit(1).count():
        whole = whole.unionByName(pieces.where("pieces > 1").groupBy("row").applyInArrow(_join_pieces, _CUT))
    return whole.select("doc_id", "n_bytes", "spans", "kept")


def _rounds(table: DataFrame, scratch: Scratch, name: str, turns: int, n_parts: int, blocks, answers) -> DataFrame:
    """The answers of all turns. The keys of a turn are shuffled and sorted, and their shuffle files deleted, before the next one's."""
    out = None
    for turn in range(turns):
        sent = table.mapInArrow(blocks(turn), _BLOCKS).repartition(n_parts, "bucket").sortWithinPartitions("bucket", "chunk")
        done = scratch.cut(sent.mapInArrow(answers, _BLOCKS), name)
        out = done if out is None else out.unionByName(done)
    return out


def _by_chunk(table: DataFrame, answers: DataFrame, n_parts: int, *order: str) -> DataFrame:
    """Rows of each chunk with its answers: these have kind 0, and their bucket as `at`."""
    given = answers.select("chunk", F.col("bucket").alias("at"), "data")
    both = table.withColumn("kind", F.lit(1)).unionByName(given.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition(n_parts, "chunk").sortWithinPartitions("chunk", *(order or ("kind", "at")))


def digest(docs: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes of every row."""
    with Scratch(docs.sparkSession) as scratch:
        done = deduplicate(docs, scratch, sizes)
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
        out = done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
        return scratch.keep(scratch.cut(out, "suffix-digests"))
