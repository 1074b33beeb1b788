"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, small_batches, utf8

#: Words of a shingle, seed of its hash, bits by which linked fingerprints differ at most, segments of a fingerprint.
SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 2, 2


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half of the shingles' hashes.

    A-Z are lower-cased, words are runs without ASCII white space; fewer words than a shingle: the whole sequence; none: 0.
    """
    hashes = shingles(text, words, seed)
    if not len(hashes):
        return 0
    return _majority(hashes)


def shingles(text: bytes, words: int, seed: int) -> np.ndarray:
    """Hashes of all shingles of a text, in order."""
    from xxhash import xxh64_intdigest

    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[words - 1 :].tolist()
    parts = map(joined.__getitem__, map(slice, starts.tolist(), ends))
    return np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64, len(ends))


def _majority(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, words, seed) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(prints.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every whole text. Null texts: 0."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def _segment(fp: Column, k: int, n: int) -> Column:
    width = 64 // n
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)) if n > 1 else fp


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """a, b: node pairs whose fingerprints differ in 1 to `distance` bits. prints: fp (distinct), node.

    Two fingerprints within `distance` agree in some segment up to distance // segments bits (pigeonhole). Each fingerprint is
    entered in a table by each of its segments; each also looks up the Hamming ball of that radius (0 or 1) around each
    segment, and what the table holds there is kept if the whole distance is small enough. A fingerprint fetches the distinct
    fingerprints that share half of its bits, never the documents behind them.
    """
    radius = distance // segments
    if radius > 1 or 64 % segments:
        raise ValueError("segments must divide 64 and leave a radius of 0 or 1")
    width = 64 // segments
    keys = F.array(*[F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), k, segments).alias("key")) for k in range(segments)])
    table = prints.select("fp", "node", F.explode(keys).alias("s")).select("fp", "node", "s.k", "s.key")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width if radius else 0)])
    probe = table.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), F.col("k").alias("k2"), F.explode(F.transform(ball, lambda x: x.bitwiseXOR(F.col("key")))).alias("key2"))
    near = (F.col("fp2") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    return probe.join(table, (F.col("k") == F.col("k2")) & (F.col("key") == F.col("key2")) & near).select(F.col("node2").alias("a"), F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most `distance` bits reach.

    docs: doc_id and text; other columns are ignored. Null texts and texts without a word have the fingerprint 0, which links
    like any other; equal fingerprints belong together; repeated doc_ids come back as often as they are; an empty table gives
    no rows. Documents are first grouped by fingerprint, so only distinct ones are compared.
    """
    prints = cut(fingerprints(docs, words, seed), "fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = components(links(classes, distance, segments))
    of_class = classes.join(found, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(of_class, F.col("fp") == F.col("of"), "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The documents without those that link to a smaller doc_id, directly or over others; all columns stay.

    One document of each group stays, the one of the smallest doc_id (rows that repeat it too). Columns may have any names.
    """
    groups = near_duplicates(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["__gone"], "left_anti")
