"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, and their memory-mapped reader.

Layout of a data set folder: for each partition `part-NNNNN`, `.ids` (little-endian unsigned integers of `width` bytes, document
after document), `.off` (little-endian 64-bit offsets, one more than documents, counted in ids from the file's start) and `.doc`
(little-endian 64-bit doc_ids). Files follow each other in ascending doc_id order. The ids before a file, and so the absolute
position of each document, come from the prefix sums of the files' sizes (`manifest`).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, new_path, small_batches, utf8
from .word_encoder import encoder

END_ID = 1
#: Bytes of text for each file, about, which bounds what a task writes and reads; documents read back at once.
FILE_BYTES, READ_DOCS = 32 << 20, 4096

#: What stands for a missing doc_id in a file.
NO_ID = -(1 << 63)

_FILES = "part int, name string, n_docs long, n_ids long, first_doc long, last_doc long"


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder:
        folder = "file://" + os.path.abspath(folder)
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", folder))


def _writer(folder: str, tokenizer_path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}"  # of this attempt: one that is lost leaves files that no manifest names
        offsets, docs, total, out = [np.zeros(1, np.int64)], [], 0, None
        for batch in batches:
            own, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.ids")
            docs.append(own.astype("<i8"))
            for part_of in blocks(texts):
                ids, counts = encoder(tokenizer_path).encode(texts[part_of])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                out.write(ids.astype(f"<u{width}").tobytes())
                offsets.append(total + ends + np.arange(1, len(ends) + 1))
                total += len(ids)
        if out is None:
            return
        out.close()
        docs = np.concatenate(docs)
        for suffix, x in (("off", np.concatenate(offsets).astype("<i8")), ("doc", docs)):
            with fs.open_output_stream(f"{root}/{name}.{suffix}") as f:
                f.write(x.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([total], pa.int64()), "first_doc": pa.array([int(docs[0])], pa.int64()), "last_doc": pa.array([int(docs[-1])], pa.int64())})

    return run


def _vocabulary(tokenizer_path: str) -> int:
    """One more than the largest id of a tokenizer."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(tokenizer_path).get_vocab().values(), default=0)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, width: int = 2, n_files: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into the files of `folder`; returns the manifest: a row for each file with its `base`.

    Rows are dealt by ranges of doc_id and sorted within them; equal doc_ids stay together, in any order. Null and empty texts
    give the end id alone, an empty table no file, rows without doc_id count as the lowest ids (NO_ID in the files). width: bytes of an id; a vocabulary that
    doesn't fit is an error. Files hold about FILE_BYTES of text each, unless n_files says otherwise.
    The manifest has one row for each file; its prefix sums are taken on the driver.
    """
    spark = docs.sparkSession
    if (most := _vocabulary(tokenizer_path)) > 1 << 8 * width:
        raise ValueError(f"ids up to {most - 1} don't fit into {width} bytes")
    rows = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n_files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_files = max(2 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    done = rows.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_writer(folder, tokenizer_path, end_id, width), _FILES)
    base, files = 0, []
    for r in sorted(done.collect(), key=lambda r: r["part"]):  # one small row for each file
        files.append((r["part"], r["name"], r["n_docs"], r["n_ids"], r["first_doc"], r["last_doc"], base))
        base += r["n_ids"]
    manifest = spark.createDataFrame(files, _FILES + ", base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped on a local or mounted file system, read whole elsewhere."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _reader(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for f in batch.to_pylist():
                ids = _mapped(fs, f"{root}/{f['name']}.ids", f"<u{width}")
                off = _mapped(fs, f"{root}/{f['name']}.off", "<i8")
                doc = _mapped(fs, f"{root}/{f['name']}.doc", "<i8")
                for at in range(0, len(doc), READ_DOCS):
                    edges = np.asarray(off[at : at + READ_DOCS + 1])
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(doc[at : at + READ_DOCS])), "start": pa.array(edges[:-1] + f["base"]), "n_tokens": pa.array(np.diff(edges)), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that the folder's manifest names."""
    files = spark.read.parquet(f"{folder}/manifest")
    n = max(1, files.count())
    out = files.repartition(n, "part").mapInArrow(_reader(folder, width), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents to the shared folder and read the files back."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    write(docs, folder, tokenizer_path, end_id)
    return read(spark, folder)
