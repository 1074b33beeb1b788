"""Span disambiguation: which of several types a range has, by the words around it.

Training counts hashed window words of uncontested spans by type; resolution compares a contested span's words with these
counts by cosine. The whole input is learned from before anything is resolved, so the result doesn't hang on row order.
`learn` and `settle` work within rows (`Redactor.redact(disambiguation=...)` uses them), `train` and `resolve` on tables of spans.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTORS = "context string, filter_type string, bucket int, n double"
#: Words that carry no type: a short list of our own. A deployment's list is given as `stop_words`.
STOP_WORDS = frozenset([
    "a", "about", "above", "after", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "off", "on", "or", "our", "out", "over", "own",
    "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will",
    "with", "you", "your",
])


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """Murmur3 x86 32-bit, as a signed int: the published algorithm."""
    mask, h = 0xFFFFFFFF, seed

    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _times(a: Column, factor: int) -> Column:
    """a * factor modulo 2^32, of a below 2^32, in halves that a long holds."""
    high = F.shiftleft((a * (factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * (factor & 0xFFFF) + high).bitwiseAND(F.lit(0xFFFFFFFF))


def _turned(a: Column, bits: int) -> Column:
    return F.shiftleft(a, bits).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftrightunsigned(a, 32 - bits))


def _through(value: Column, *steps) -> Column:
    """steps applied one after another, each to a value that is computed once."""
    out = F.array(value)
    for step in steps:
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def murmur3(text: Column) -> Column:
    """murmur3_32 as a Column, in the JVM."""
    mixed = lambda k: _times(_turned(_times(k, 0xCC9E2D51), 15), 0x1B873593)

    def hashed(digits: Column) -> Column:
        size = (F.length(digits) / 2).cast("int")

        def block(i: Column) -> Column:  # up to four bytes from the i-th on, the first one lowest
            pairs = [F.substring(digits, i * 8 + 2 * k + 1, F.lit(2)) for k in (3, 2, 1, 0)]
            return F.coalesce(F.conv(F.concat(*pairs), 16, 10).cast("long"), F.lit(0).cast("long"))

        whole = F.floor(size / 4).cast("int")
        blocks = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), block)).otherwise(F.array().cast("array<long>"))
        zero = F.lit(0).cast("long")
        body = F.aggregate(blocks, zero, lambda h, k: (_times(_turned(h.bitwiseXOR(mixed(k)), 13), 5) + 0xE6546B64).bitwiseAND(F.lit(0xFFFFFFFF)))
        tail = F.when(size % 4 > 0, body.bitwiseXOR(mixed(block(whole)))).otherwise(body)
        last = _through(
            tail.bitwiseXOR(size.cast("long")), lambda h: _times(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x85EBCA6B), lambda h: _times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), 0xC2B2AE35),
            lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 16)),
        )
        return _through(last, lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)).cast("int")

    return _through(F.hex(F.encode(text, "UTF-8")), hashed)


def polynomial(text: Column) -> Column:
    """The 31-polynomial hash of a string's characters."""
    wrapped = lambda c: F.when(c.bitwiseAND(F.lit(0xFFFFFFFF)) >= 1 << 31, c.bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 32)).otherwise(c.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + F.ascii(c))).cast("int")


def _buckets(spans: DataFrame, size: int, stop_words: bool | Collection[str], algorithm: str, *keys: str) -> DataFrame:
    """keys, bucket: the distinct hash buckets of the words in each span's window."""
    word = F.lower(F.col("word"))
    words = spans.select(*keys, F.explode("window").alias("word")).where(word != "")
    if stop_words:
        words = words.where(~word.isin(sorted(STOP_WORDS if stop_words is True else {w.lower() for w in stop_words})))
    hashed = murmur3(word) if algorithm == "murmur3" else polynomial(word)
    return words.select(*keys, F.abs(hashed % size).cast("int").alias("bucket")).distinct()


def _contested(spans: DataFrame, key: str) -> DataFrame:
    """spans with `types`: how many types their range has."""
    at = [key, "character_start", "character_end"]
    types = spans.groupBy(*at).agg(F.count_distinct("filter_type").alias("types"))
    return spans.join(types, at)


def train(spans: DataFrame, size: int = 512, stop_words: bool | Collection[str] = True, algorithm: str = "murmur3", key: str = "doc_id") -> DataFrame:
    """context, filter_type, bucket, n from exploded spans (key, context, filter_type, range, window) that no other type contests."""
    own = _contested(spans, key).where("types = 1").withColumn("__s", F.struct(key, "character_start", "character_end"))
    return _buckets(own, size, stop_words, algorithm, "__s", "context", "filter_type").groupBy("context", "filter_type", "bucket").agg(F.count("*").cast("double").alias("n"))


def resolve(spans: DataFrame, vectors: DataFrame, size: int = 512, stop_words: bool | Collection[str] = True, algorithm: str = "murmur3", key: str = "doc_id") -> DataFrame:
    """spans of which each range keeps one type: the one whose vector is nearest to the span's words; ties: the first found."""
    at = [key, "character_start", "character_end"]
    marked = _contested(spans, key)
    contested = marked.where("types > 1")
    words = _buckets(contested, size, stop_words, algorithm, *at, "context", "filter_type")
    lengths = words.groupBy(*at, "context", "filter_type").agg(F.count("*").alias("m"))
    norms = vectors.groupBy("context", "filter_type").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dots = words.join(vectors, ["context", "filter_type", "bucket"]).groupBy(*at, "context", "filter_type").agg(F.sum("n").alias("dot"))
    scored = contested.join(lengths, [*at, "context", "filter_type"], "left").join(dots, [*at, "context", "filter_type"], "left").join(norms, ["context", "filter_type"], "left")
    cosine = F.coalesce(F.col("dot") / (F.sqrt("m") * F.col("norm")), F.lit(0.0))
    best = scored.withColumn("__c", cosine).groupBy(*at).agg(F.max_by("filter_type", F.struct("__c", (-F.col("ordinal")).alias("o"))).alias("__best"))
    kept = contested.join(best, at).where(F.col("filter_type") == F.col("__best")).drop("__best")
    return marked.where("types = 1").unionByName(kept).drop("types")


# ---- within rows --------------------------------------------------------------------------------------------------------
#: Contexts up to which the vectors of all of them are broadcast (each has types x size counts at most).
FEW_CONTEXTS = 200


@dataclass(frozen=True)
class Disambiguation:
    """How spans of one range and several types are told apart.

    stop_words: a list, or a text with commas; ignore_stop_words: whether these words are left out.
    """

    size: int = 512
    ignore_stop_words: bool = True
    algorithm: str = "murmur3"
    stop_words: str | Collection[str] = STOP_WORDS

    def __post_init__(self):
        if self.algorithm.lower() not in ("murmur3", "hashcode") or self.size < 1:
            raise ValueError(f"unknown algorithm '{self.algorithm}' or size {self.size}")

    def buckets(self, window: Column) -> Column:
        """The distinct buckets of a window's words."""
        words = F.filter(F.transform(window, lambda w: F.lower(F.trim(w))), lambda w: w != "")
        given = self.stop_words.split(",") if isinstance(self.stop_words, str) else self.stop_words
        if self.ignore_stop_words and (stopped := sorted({w.strip().lower() for w in given} - {""})):
            words = F.filter(words, lambda w: ~w.isin(stopped))
        one = murmur3 if self.algorithm.lower() == "murmur3" else polynomial
        return F.array_distinct(F.transform(words, lambda w: F.abs(one(w) % self.size).cast("int")))


def _rivals(spans: Column, x: Column) -> Column:
    """Types of the spans of x's range, in the order found."""
    same = F.filter(spans, lambda y: (y["character_start"] == x["character_start"]) & (y["character_end"] == x["character_end"]))
    return F.array_distinct(F.transform(same, lambda y: y["filter_type"]))


def learn(found: DataFrame, how: Disambiguation) -> DataFrame:
    """VECTORS from the column `spans` of rows: how many uncontested spans of each context and type have a word of each bucket near them."""
    own = F.filter("spans", lambda x: F.size(_rivals(F.col("spans"), x)) == 1)
    marks = F.flatten(F.transform(own, lambda x: F.transform(how.buckets(x["window"]), lambda b: F.struct(x["context"].alias("context"), x["filter_type"].alias("filter_type"), b.alias("bucket")))))
    return found.select(F.explode(marks).alias("m")).groupBy("m.context", "m.filter_type", "m.bucket").agg(F.count("*").cast("double").alias("n"))


_PACKED = "map<string,struct<norm:double,counts:map<int,double>>>"


def packed(vectors: DataFrame) -> DataFrame:
    """A row for each context: its vectors by type, each with its norm and its counts that aren't zero."""
    types = vectors.groupBy("context", "filter_type").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    return types.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("filter_type", F.struct("norm", "counts")))).cast(_PACKED).alias("vectors"))


def _similarity(vectors: Column, kind: Column, buckets: Column) -> Column:
    """The cosine of a window and a type; 0 where one of them is empty."""
    own = F.try_element_at(vectors, kind)
    dot = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.coalesce(F.try_element_at(own["counts"], b), F.lit(0.0)))
    return F.coalesce(F.try_divide(dot, F.sqrt(F.size(buckets)) * own["norm"]), F.lit(0.0))


def settled_types(spans: Column, vectors: Column, how: Disambiguation) -> Column:
    """spans of which each range keeps one type: the first of those whose vector is nearest to the words around it."""

    def rated(x: Column) -> Column:
        return F.struct(x.alias("x"), _rivals(spans, x).alias("types"))

    def judged(r: Column) -> Column:
        def best(buckets: Column) -> Column:
            start = F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("kind"))

            def step(acc: Column, kind: Column) -> Column:
                score = _similarity(vectors, kind, buckets)
                return F.when(score > acc["score"], F.struct(score.alias("score"), kind.alias("kind"))).otherwise(acc)

            return F.aggregate(r["types"], start, step, lambda acc: acc["kind"])

        winner = F.when(F.size(r["types"]) == 1, F.get(r["types"], F.lit(0))).otherwise(_through(how.buckets(r["x"]["window"]), best))
        return F.struct(r["x"].alias("x"), winner.alias("winner"))

    kept = F.filter(F.transform(F.transform(spans, rated), judged), lambda j: j["x"]["filter_type"] == j["winner"])
    return F.transform(kept, lambda j: j["x"])


def settle(found: DataFrame, vectors: DataFrame, how: Disambiguation, context: str | Column) -> DataFrame:
    """found (rows with `spans`) with one type for each range. Nothing is exploded.

    With one context for all rows its vectors are a single value; otherwise they are joined by the rows' context, by broadcast where there are
    FEW_CONTEXTS at most. Rows of contexts that nothing was learned of keep the first type of each range.
    """
    if isinstance(context, str):
        one = packed(vectors.where(F.col("context") == context)).agg(F.first("vectors").alias("vectors")).scalar()
        return found.withColumn("__vectors", one).withColumn("spans", settled_types(F.col("spans"), F.col("__vectors"), how)).drop("__vectors")
    table = packed(vectors).withColumnsRenamed({"context": "__of", "vectors": "__vectors"})
    few = vectors.select("context").distinct().limit(FEW_CONTEXTS + 1).count() <= FEW_CONTEXTS
    joined = found.withColumn("__context", context).join(F.broadcast(table) if few else table, F.col("__context") == F.col("__of"), "left")
    return joined.withColumn("spans", settled_types(F.col("spans"), F.col("__vectors"), how)).drop("__context", "__of", "__vectors")


def save(vectors: DataFrame, path: str, size: int = 512, algorithm: str = "murmur3", version: int = 1) -> None:
    vectors.withColumns({"version": F.lit(version), "size": F.lit(size), "algorithm": F.lit(algorithm)}).write.mode("overwrite").parquet(path)


def load(spark, path: str, size: int = 512, algorithm: str = "murmur3", version: int = 1) -> DataFrame:
    """Saved vectors, or none where version, size or algorithm are other ones."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("version") == version) & (F.col("size") == size) & (F.col("algorithm") == algorithm)).select("context", "filter_type", "bucket", "n")
