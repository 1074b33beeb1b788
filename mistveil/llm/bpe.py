"""Byte-level BPE by ranks: overlapping chunk encoding of whole texts, and decoding by concatenation of raw bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches

#: Code points of a chunk, and of its overlap with the next. Texts of at most one chunk are encoded where they are read.
CHUNK, OVERLAP = 32_768, 512
#: How much wider overlaps are where one holds no boundary that both scans share.
WIDER = 16
#: A match that starts so near the end of a chunk, or touches it, could go on differently in the whole text.
_UNSURE = 4


@lru_cache(maxsize=2)
def codec(path: str, pattern: str):
    """(tiktoken encoding, compiled pattern, bytes of each id, decimal digits of each id) of a rank file, once in a worker."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        pieces[i] = raw
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding, regex.compile(pattern), pieces, [str(i) for i in range(len(pieces))]


def boundaries(text: str, pattern, low: int, high: int) -> list[int]:
    """Ends of the pattern's matches in text that lie in [low, high] and follow no white space."""
    return [m.end() for m in pattern.finditer(text) if low <= m.end() <= high and not text[m.end() - 1].isspace()]


def stitch(chunks: list[tuple[int, int, list[int], list[int]]]) -> tuple[list[int], bool]:
    """Positions of one text at which it may be cut: for each pair of neighbours, their first common match boundary; and whether all pairs had one.

    chunks: (start, end, boundaries near the start, sure boundaries near the end), in order. From the first true boundary on,
    a scan depends on what follows only; so where the scan of a chunk, true from its own first cut on, and that of the next
    chunk share a boundary, they agree from there. Where a pair shares none (a run without a boundary is longer than the
    overlap), the next scan can't be trusted, and the text has to be scanned again with wider overlaps.
    """
    cuts = []
    for (_, _, _, tail), (_, _, head, _) in zip(chunks, chunks[1:], strict=False):
        after = cuts[-1] if cuts else 0
        common = sorted(x for x in set(tail) & set(head) if x > after)
        if not common:
            return cuts, False
        cuts.append(common[0])
    return cuts, True


def _digest(ids: list[int], pieces: list[bytes], digits: list[str]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(map(pieces.__getitem__, ids))).hexdigest()


def _split(chunk: int, overlap: int):
    """Rows of documents to rows of chunks: (doc_id, row, start, n, text); a short text is one chunk, n the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                starts = list(range(0, max(1, len(text) - overlap), chunk - overlap))
                for at in range(0, len(starts), 64):
                    own = starts[at : at + 64]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(own), pa.int64()), "row": pa.array([row] * len(own), pa.int64()), "start": pa.array(own, pa.int64()), "n": pa.array([len(text)] * len(own), pa.int64()), "text": [text[s : s + chunk] for s in own]})

    return run


def _whole(path: str, pattern: str):
    """Encode, decode and digest whole short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _, pieces, digits = codec(path, pattern)
        for batch in batches:
            rows = [_digest(encoding.encode_ordinary(t or ""), pieces, digits) for t in batch.column(1).to_pylist()]
            n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(raw, pa.string())})

    return run


def _scan(path: str, pattern: str, overlap: int):
    """Pre-tokenise chunks in parallel; of the boundaries, only those of the overlaps are needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = codec(path, pattern)[1]
        for rows in batches:
            out = []
            for start, text in zip(rows["start"], rows["text"], strict=True):
                found = np.array(boundaries(text, compiled, 1, len(text) - _UNSURE), np.int64)
                out.append(((start + found[found <= overlap]).tolist(), (start + found[found >= len(text) - overlap]).tolist()))
            yield rows[["doc_id", "row", "start", "n"]].assign(end=rows["start"] + rows["text"].str.len(), head=[h for h, _ in out], tail=[t for _, t in out])

    return run


def _cuts(rows: pd.DataFrame) -> pd.DataFrame:
    """Cuts of one document, from the boundaries in its overlaps."""
    rows = rows.sort_values("start")
    cuts, whole = stitch(list(zip(rows["start"], rows["end"], map(list, rows["head"]), map(list, rows["tail"]), strict=True)))
    return pd.DataFrame({"row": [rows["row"].iloc[0]], "cuts": [cuts], "whole": [whole]})


def cut_places(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """row, cuts of each text of long (doc_id, row, text).

    Texts in which some overlap holds no common boundary are scanned again with wider ones, until those are wide enough, at the
    latest when one chunk holds the text; so a piece is longer than two chunks only where a run without a boundary is.
    """
    out, left = None, long
    while True:
        chunks = left.mapInArrow(_split(chunk, overlap), "doc_id long, row long, start long, n long, text string").hint("rebalance")
        scanned = chunks.mapInPandas(_scan(path, pattern, overlap), "doc_id long, row long, start long, n long, end long, head array<long>, tail array<long>")
        cuts = cut(scanned.groupBy("row").applyInPandas(_cuts, "row long, cuts array<long>, whole boolean"), "cuts")
        done = cuts.where("whole").select("row", "cuts")
        out = done if out is None else out.unionByName(done)
        if not cuts.where("not whole").limit(1).count():
            return out
        left = left.join(cuts.where("not whole").select("row"), "row", "left_semi").select("doc_id", "row", "text")
        overlap, chunk = overlap * WIDER, max(chunk, 4 * overlap * WIDER)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text, cuts) to the texts between the cuts."""
    for batch in batches:
        for doc, row, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            edges = [0, *cuts, len(text)]
            for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int64()), "text": pa.array([text[s:e]], pa.string())})


def _encoded(path: str, pattern: str):
    """Encode the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(path, pattern)[0]
        for batch in batches:
            ids = [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row": batch.column(1), "k": batch.column(2), "ids": pa.array(ids, pa.binary())})

    return run


def _joined(path: str, pattern: str):
    """The digest of one document from its pieces, in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, _, pieces, digits = codec(path, pattern)
        names, raw, n = hashlib.sha256(), hashlib.sha256(), 0
        for ids in rows.sort_values("k")["ids"]:
            own = np.frombuffer(ids, "<u4").tolist()
            if own:
                names.update((" " * bool(n) + " ".join(map(digits.__getitem__, own))).encode())
                raw.update(b"".join(map(pieces.__getitem__, own)))
                n += len(own)
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "n_tokens": [n], "ids_sha256": [names.hexdigest()], "decoded_sha256": [raw.hexdigest()]})

    return run


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by a space) and of the decoded bytes of each whole text.

    docs: doc_id and text; other columns are ignored. Texts of at most `chunk` code points are encoded where they are read,
    without a shuffle. Longer ones are cut into overlapping chunks, which tasks pre-tokenise independently; `stitch` finds the
    cuts, tasks encode the pieces between them, and the digest of a document goes through its pieces in order. Null and empty
    texts give no ids; repeated doc_ids come back as often as they are; an empty table gives no rows.
    """
    if overlap <= _UNSURE or chunk <= 2 * overlap:
        raise ValueError("a chunk must be longer than two overlaps")
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = rows.where(~is_long).mapInArrow(_whole(path, pattern), _RESULT)
    long = cut(rows.where(is_long).select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "long-texts")
    cuts = cut_places(long, path, pattern, chunk, overlap)
    pieces = long.join(cuts, "row").select("doc_id", "row", "text", "cuts").mapInArrow(_slices, "doc_id long, row long, k long, text string").hint("rebalance")
    encoded = pieces.mapInArrow(_encoded(path, pattern), "doc_id long, row long, k long, ids binary")
    return short.unionByName(encoded.groupBy("row").applyInPandas(_joined(path, pattern), _RESULT))


def encode(texts: list[str], path: str, pattern: str) -> list[list[int]]:
    """Ids of some texts, in this process."""
    return [codec(path, pattern)[0].encode_ordinary(t) for t in texts]


def decode(ids: list[list[int]], path: str, pattern: str) -> list[bytes]:
    """Raw bytes of some sequences of ids, in this process."""
    pieces = codec(path, pattern)[2]
    return [b"".join(map(pieces.__getitem__, x)) for x in ids]
