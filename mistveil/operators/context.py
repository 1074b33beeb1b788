"""Consistent replacements: one value for each (context, token), kept in a table that later runs extend."""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anonymize, keyed

SCHEMA = "context string, token string, replacement string"


class ContextTable:
    """(context, token, replacement) as a log of immutable Parquet folders, for any number of writers. A token keeps the value it got first.

    `log/` holds numbered entries, `data/` the rows that they name. An entry is put in place whole, under a number that nobody else can take, so readers
    see all of a write or nothing, and a writer that dies leaves rows that no entry names. What counts follows from the entries
    in order: the first value that was added, or the last one that was put; nothing from before its context was cleared; nothing
    older than the time to live. `compact` writes the outcome as one folder; `vacuum` deletes what nobody reads any more.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: float | None = None, compact_after: int = 50):
        """ttl_seconds: values are forgotten so long after they were written. compact_after: entries since the last compaction that bring the next."""
        self.spark, self.path, self.ttl, self.compact_after = spark, path.rstrip("/"), ttl_seconds, compact_after
        self._fs().mkdirs(self._at("log"))

    # ---- the log ----

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """What counts: the last compaction and the entries after it, in order of their numbers."""
        numbers = self._numbers()
        later: list[dict] = []
        for number in reversed(numbers):
            entry = self._read_entry(number)
            if entry["op"] == "compact":  # others may have made entries between what it read and its own number
                between = [self._read_entry(n) for n in numbers if entry["upto"] < n < number]
                return [entry, *(e for e in between if e["op"] != "compact"), *later]
            later.insert(0, entry)
        return later

    def _numbers(self) -> list[int]:
        names = [status.getPath().getName() for status in self._fs().listStatus(self._at("log"))]
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def _read_entry(self, number: int) -> dict:
        stream = self._fs().open(self._at("log", f"{number:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": number}
        finally:
            stream.close()

    def _publish(self, entry: dict) -> int:
        """Put an entry in place under the next free number: written beside the log, then renamed, which fails where the number is taken."""
        jvm, fs = self.spark._jvm, self._fs()
        beside = self._at("log", f".{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        stream.write(bytearray(json.dumps(entry | {"at": time.time()}).encode()))
        stream.close()
        number = max(self._numbers(), default=0)
        while True:
            number += 1
            final = self._at("log", f"{number:012}.json")
            if fs.getUri().getScheme() == "file":  # a hard link is made only where there is no such name; local renames overwrite
                try:
                    os.link(beside.toUri().getPath(), final.toUri().getPath())
                    fs.delete(beside, False)
                    return number
                except FileExistsError:
                    continue
            if not fs.exists(final) and fs.rename(beside, final):
                return number

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select("context", "token", "replacement", F.col("at").cast("double").alias("at")).write.parquet(f"{self.path}/data/{name}")
        return name

    def _after(self, number: int) -> None:
        if number % self.compact_after == 0:
            self.compact()

    # ---- reading ----

    def _state(self, entries: list[dict]) -> DataFrame:
        """context, token, replacement, at as the entries leave them."""
        parts = {e["data"]: e for e in entries if e.get("data")}
        if not parts:
            return self.spark.createDataFrame([], f"{SCHEMA}, at double")
        known = self.spark.createDataFrame([(d, e.get("upto", e["number"]), e["op"] == "put", e["at"]) for d, e in parts.items()], "part string, number long, put boolean, written double")
        folder = F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1)
        rows = self.spark.read.schema(f"{SCHEMA}, at double").parquet(*[f"{self.path}/data/{d}" for d in parts]).withColumn("part", folder)
        rows = rows.join(F.broadcast(known), "part").withColumn("at", F.coalesce("at", "written"))  # one small row for each entry
        cleared = [(e["context"], e["number"]) for e in entries if e["op"] == "clear"]
        if cleared:
            gone = self.spark.createDataFrame(cleared, "gone string, upto long").groupBy("gone").agg(F.max("upto").alias("upto"))
            rows = rows.join(gone, F.col("context").eqNullSafe(F.col("gone")), "left").where("upto IS NULL OR number > upto")
        if self.ttl is not None:
            rows = rows.where(F.col("at") > F.lit(time.time() - self.ttl))
        # the last value that was put, else the first one that was added; of one entry the smallest
        order = F.when(F.col("put"), -F.col("number") - (1 << 60)).otherwise(F.col("number"))
        best = rows.groupBy("context", "token").agg(F.min(F.struct(order.alias("order"), "replacement", "at")).alias("x"))
        return best.select("context", "token", "x.replacement", "x.at")

    def read(self) -> DataFrame:
        return self._state(self.entries()).select("context", "token", "replacement")

    def get(self, context: str, token: str) -> str | None:
        row = self.read().where((F.col("context") == context) & (F.col("token") == token)).first()
        return row["replacement"] if row else None

    # ---- writing ----

    def add(self, rows: DataFrame) -> None:
        """Add the rows whose key is new; where another writer adds the same key at the same time, the entry that is in place first counts."""
        new = rows.join(self.read().select("context", "token"), ["context", "token"], "left_anti")
        self._after(self._publish({"op": "add", "data": self._write(new.select("context", "token", "replacement", F.lit(None).alias("at")))}))

    def put(self, rows: DataFrame) -> None:
        """Add the rows, or replace the values of their keys."""
        self._after(self._publish({"op": "put", "data": self._write(rows.select("context", "token", "replacement", F.lit(None).alias("at")))}))

    def clear(self, context: str) -> None:
        """Forget all that a context holds so far."""
        self._after(self._publish({"op": "clear", "context": context}))

    def compact(self) -> None:
        """Write what counts now as one folder. Entries that others make meanwhile come after it, whatever their number."""
        entries = self.entries()
        if len(entries) > 1:
            upto = max(e["number"] for e in entries)
            self._publish({"op": "compact", "upto": upto, "data": self._write(self._state(entries))})

    def vacuum(self, older_seconds: float = 86_400) -> None:
        """Delete entries and rows that no reader needs, once they are so old that no reader or writer that began with them still runs."""
        entries, fs = self.entries(), self._fs()
        used = {e["data"] for e in entries if e.get("data")}
        first = entries[0].get("upto", 0) if entries else 0
        before = (time.time() - older_seconds) * 1000
        for status in [*fs.listStatus(self._at("log")), *(fs.listStatus(self._at("data")) if fs.exists(self._at("data")) else [])]:
            name, old = status.getPath().getName(), status.getModificationTime() <= before
            done = int(name[:12]) <= first if re.fullmatch(r"\d{12}\.json", name) else name not in used
            if old and done:
                fs.delete(status.getPath(), True)


def generated(tokens: DataFrame, seed: int = 0, method: str = "realistic", lists: dict[str, list[str]] | None = None, secret: str | bytes | None = None) -> DataFrame:
    """context, token, replacement for distinct (context, token, filter_type): the value hangs on the secret, seed, context and token only.

    Without a secret one is drawn now: values agree within this result, and with no other one.
    """
    key = keyed.given(secret) if secret else keyed.fresh()

    def run(batches):
        for rows in batches:
            values = [anonymize.anonymize(f, t, f"{seed}|{c}|{t}", method, None, lists, key) for c, t, f in zip(rows["context"], rows["token"], rows["filter_type"], strict=True)]
            yield rows[["context", "token"]].assign(replacement=values)

    one = tokens.groupBy("context", "token").agg(F.min("filter_type").alias("filter_type"))  # the type isn't part of the key
    return one.mapInPandas(run, SCHEMA)


def consistent(spans: DataFrame, table: ContextTable | None = None, seed: int = 0, method: str = "realistic", lists=None, secret: str | bytes | None = None) -> DataFrame:
    """Exploded spans (context, text, filter_type) with the replacement of their (context, token), the same in all documents.

    Distinct tokens are aggregated before anything is made or joined; values the table knows are used, new ones are added.
    """
    tokens = spans.select("context", F.col("text").alias("token"), "filter_type")
    if table is not None:
        table.add(generated(tokens.join(table.read().select("context", "token"), ["context", "token"], "left_anti"), seed, method, lists, secret))
        values = table.read()
    else:
        values = generated(tokens, seed, method, lists, secret)
    values = values.select(F.col("context").alias("__c"), F.col("token").alias("__t"), F.col("replacement").alias("__r"))
    return spans.join(values, (F.col("context") == F.col("__c")) & (F.col("text") == F.col("__t")), "left").withColumn("replacement", F.coalesce("__r", "replacement")).drop("__c", "__t", "__r")


def apply_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with filtered_text: the replacements of a table of spans (key, character_start, character_end, replacement) put in.

    Also re-applies spans that were saved earlier. Spans of a document must not overlap.
    """
    own = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("character_start", "character_end", "replacement"))).alias("__spans"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.substring(F.col(text), acc["at"] + 1, x["character_start"] - acc["at"])
        return F.struct(x["character_end"].cast("int").alias("at"), F.concat(acc["out"], gap, x["replacement"]).alias("out"))

    done = F.aggregate("__spans", zero, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text)))))
    return docs.join(own, key, "left").withColumn("filtered_text", F.when(F.col("__spans").isNull(), F.col(text)).otherwise(done)).drop("__spans")
