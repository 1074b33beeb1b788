"""Helpers that several operators use: shared scratch tables and text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside a task, in bytes: bounds the memory of the numpy stages.
BLOCK_BYTES = 4 << 20
#: Largest Arrow batches that operators on texts ask for.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mistveil-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Those that own the scratch tables made now, the innermost last.
_OWNERS: list[Owner] = []


class Owner:
    """Owns every scratch path that is made while its block runs, and deletes all but those it is told to keep when the block ends.

    Operators whose result reads several tables don't know when these are done with; their caller does: it writes the result
    (`result`) and lets the rest go. Without an owner such tables stay until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._kept = spark, [], set()

    def __enter__(self) -> Owner:
        _OWNERS.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNERS.remove(self)
        for path in self._paths:
            if path not in self._kept:
                delete(self.spark, path)
        if _OWNERS:  # what is kept belongs to whoever asked for it
            _OWNERS[-1]._paths += self._kept

    def own(self, path: str) -> None:
        self._paths.append(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; nothing else is needed for it from then on."""
        path = new_path(self.spark, name)
        self._kept.add(path)
        return write(df, path)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """df, written, and all that led to it deleted at once."""
        before, path = self._paths, new_path(self.spark, name)
        out = write(df, path)
        for old in before:
            if old != path:
                delete(self.spark, old)
        self._paths = [path]
        return out


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].own(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later uses don't compute it again, and lost executors cost nothing.

    What led to it isn't needed from then on, so its shuffle files are deleted.
    """
    return write(df, new_path(df.sparkSession, name))


#: Larger than any file's content, for files that hold one row group.
ONE_GROUP = 1 << 30


def write(df: DataFrame, path: str, one_group: bool = False, dictionary: bool = True) -> DataFrame:
    """one_group: each file has a single row group, so that one task reads all of it, in the order written. Without a dictionary, hashes are written faster."""
    spark, schema = df.sparkSession, df.schema
    with shuffles_freed(spark):
        out = df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower())
        (out.option("parquet.block.size", ONE_GROUP) if one_group else out).parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows up to which a table of a few numbers is sent to every executor; beyond, its joins shuffle.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has no more than `most` (SMALL_ROWS) rows, which are counted for that (rows: where they are known)."""
    most = SMALL_ROWS if most is None else most
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Tables written to the shared folder for one job; those that aren't kept are deleted when the block ends, or earlier by drop."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for df in [x for x, _ in self._paths.values()]:
            self.drop(df)

    def cut(self, df: DataFrame, name: str, one_group: bool = False, dictionary: bool = True) -> DataFrame:
        path = new_path(self.spark, name)
        out = write(df, path, one_group, dictionary)
        self._paths[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self._paths.pop(id(df), None)
        return df

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions in here delete their shuffle files when they end, for results that aren't computed twice from the same plan."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded to BATCH_ROWS rows and BATCH_BYTES bytes where they were larger.

    A Python worker holds a few batches at a time; with long texts, batches of the default 10,000 rows would not be bounded.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).rstrip("bB")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null gives b""."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[slice]:
    """Consecutive slices of about `most` bytes; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def filter_texts(docs: DataFrame, judge: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of docs whose text `judge` keeps (it gets UTF-8 texts, null as b""), with all columns: one pass, no shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(at))
            yield batch.filter(pa.array([k for part in blocks(texts) for k in judge(texts[part])], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
