"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filter_texts, small_batches, utf8

#: Buckets of the subword hash, size of an embedding, lengths of subwords in bytes.
BUCKETS, SIZE, ORDERS = 1 << 14, 16, (1, 2, 3, 4)
#: Labelled documents to learn from at most: of a language (those of the smallest hash of doc_id), and of all languages together.
#: Where languages are so many that the sum is reached, each has an equal part of it, but LEAST_SAMPLE at least.
SAMPLE, BUDGET, LEAST_SAMPLE = 600, 38400, 5
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.05, 7
UNKNOWN = "und"
#: A prediction is rejected where it is more likely wrong than right, as calibrated on held-back labelled documents.
LEAST_SCORE = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LOWER[~_LETTER] = 32
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subword_blocks(text: bytes, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams of a text, ASCII lower-cased, runs of what isn't a letter as one space.

    In blocks of `most` places at which n-grams begin, so that a long text isn't held several times over; none is left out.
    """
    b = _LOWER[np.frombuffer(text, np.uint8)]
    space = b == 32
    if len(b):
        b = b[~(space & np.concatenate([[True], space[:-1]]))]
    if not len(b) or not (b != 32).any():
        return
    b = np.pad(b[:-1] if b[-1] == 32 else b, 1, constant_values=32)
    for at in range(0, len(b), most):
        out = []
        for n in ORDERS:
            part = b[at : at + most + n - 1].astype(np.uint32)
            h = np.full(max(0, len(part) - n + 1), n, np.uint32)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * _MIX[k]
                h ^= h >> np.uint32(15)
            out.append(h % np.uint32(BUCKETS))
        yield np.concatenate(out).astype(np.int64)


def subwords(text: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *subword_blocks(text)])


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # of each bucket: scores (embedding times softmax weights, divided by the temperature), or its embedding
    bias: np.ndarray
    weights: np.ndarray | None = None  # softmax weights, divided by the temperature, where the table holds embeddings

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; UNKNOWN and 0 where a text has no letter."""
        names, scores = [], np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not self.languages or not has_letter(t):
                names.append(UNKNOWN)
                continue
            total, n = np.zeros(self.table.shape[1]), 0
            for own in subword_blocks(t):
                total += self.table[own].sum(axis=0, dtype=np.float64)
                n += len(own)
            z = total / max(1, n)
            z = (z if self.weights is None else z @ self.weights) + self.bias
            p = np.exp(z - z.max())
            k = int(np.argmax(p))
            names.append(self.languages[k])
            scores[i] = p[k] / p.sum()
        return names, scores


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, weight = [], []
        for t in utf8(batch.column(1)):
            all_ = np.zeros(BUCKETS, np.int64)
            for own in subword_blocks(t):
                all_ += np.bincount(own, minlength=BUCKETS)
            i = np.flatnonzero(all_)
            n = all_[i]
            index.append(i.astype("<u2").tobytes())
            weight.append((n / max(1, n.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(2), "lang": batch.column(0), "index": pa.array(index, pa.binary()), "weight": pa.array(weight, pa.binary())})


def sampled(labelled: DataFrame, by: str, most: int) -> DataFrame:
    """doc_id of at most `most` rows of each value of `by`, those of the smallest hash of doc_id: a bounded sample of every value.

    The threshold on the hash comes from the counts; what is over is cut off by rank among the few rows left. Counts stay in Spark.
    """
    top = (1 << 62) - 1
    counts = labelled.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("of")).agg(F.count("*").alias("n"))
    limits = counts.select("of", F.least(F.lit(float(top)), F.lit(top * 1.2 * most) / F.col("n")).cast("long").alias("limit"))
    rows = labelled.select("doc_id", by, F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("chance"))
    rows = rows.join(F.broadcast(limits), (F.col(by) == F.col("of")) & (F.col("chance") <= F.col("limit")))
    picked = rows.groupBy(by).agg(F.slice(F.sort_array(F.collect_set(F.struct("chance", "doc_id"))), 1, most).alias("rows"))
    return picked.select(F.explode("rows.doc_id").alias("doc_id"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from labelled (doc_id, text, lang): at most `sample` documents of each language, counted where they lie; fewer of
    each, but of every language, where they would be over BUDGET together.

    Only hashed counts of the sample reach the driver. A fifth of it is held back to calibrate: the temperature that divides
    the scores makes the softmax's probability the share of right predictions. Rows without lang or text teach nothing.
    """
    rows = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    most = min(sample, max(LEAST_SAMPLE, BUDGET // max(1, rows.select("lang").distinct().count())))
    chosen = sampled(rows, "lang", most).distinct()
    counted = rows.join(F.broadcast(chosen), "doc_id").select("lang", "text", "doc_id").mapInArrow(_counts, "doc_id long, lang string, index binary, weight binary")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("lang", "index", "weight")).alias("r")).select("r.*")  # a doc_id counts once, however often it is repeated
    got = one.collect()  # bounded by BUDGET, or LEAST_SAMPLE a language
    names = sorted({r["lang"] for r in got})
    rng = np.random.default_rng(SEED)
    order = sorted(range(len(got)), key=lambda i: (zlib.crc32(bytes(got[i]["index"])), i))
    index = [np.frombuffer(got[i]["index"], "<u2") for i in order]
    weight = [np.frombuffer(got[i]["weight"], "<f4") for i in order]
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[got[i]["lang"]] for i in order], np.int64)
    n, k = len(y), len(names)
    if k < 2:
        return LanguageModel(names, np.zeros((BUCKETS, max(1, k)), np.float32), np.zeros(max(1, k)))

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for j, r in enumerate(rows):
            x[j, index[r]] = weight[r]
        return x

    embedding = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    w, bias = np.zeros((SIZE, k), np.float32), np.zeros(k, np.float32)
    w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    held = np.arange(n) % 5 == 4
    own = np.flatnonzero(~held)
    grads = [np.full_like(x, 1e-8) for x in (embedding, w, bias)]
    for epoch in range(EPOCHS):
        for at in range(0, len(own), BATCH):
            if at == 0:
                rng.shuffle(own)
            rows_now = own[at : at + BATCH]
            x = dense(rows_now)
            mean = x @ embedding
            z = mean @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows_now)), y[rows_now]] -= 1
            p /= len(rows_now)
            steps = (x.T @ (p @ w.T), mean.T @ p, p.sum(axis=0))
            for value, g2, g in zip((embedding, w, bias), grads, steps, strict=True):  # stochastic gradient steps, scaled as AdaGrad does
                g2 += g * g
                value -= RATE * g / np.sqrt(g2)
    wide = k > SIZE  # then embeddings are the smaller table
    table = embedding if wide else embedding @ w
    check = np.flatnonzero(held) if held.sum() >= 10 else np.arange(n)
    z = np.stack([(table[index[i]] * weight[i][:, None]).sum(axis=0) for i in check])
    z = (z @ w if wide else z) + bias
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 60):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(check)), y[check]]))
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    bias = (bias / temperature).astype(np.float64)
    return LanguageModel(names, table, bias, w / temperature) if wide else LanguageModel(names, (table / temperature).astype(np.float32), bias)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(utf8(batch.column(1)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array([n == UNKNOWN or s < LEAST_SCORE for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_())})

    return run


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def identify(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each document (doc_id, text, lang).

    Learns from rows of `labelled` (default: docs) whose crc32(doc_id) mod 3 is not 1. Null texts and texts without a letter
    are `und` with score 0; score is the calibrated probability of lang_pred; rejected: `und`, or more likely wrong than
    right. Repeated rows come back as often as they are, an empty table gives no rows; other columns are ignored.
    """
    source = docs if labelled is None else labelled
    model = train(source.where(_remainder(3) != 1), sample)
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (_remainder(3) == 1).alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def _judge(model: LanguageModel):
    def judge(texts: list[bytes]) -> list[bool]:
        names, scores = model.predict(texts)
        return [n != UNKNOWN and s >= LEAST_SCORE for n, s in zip(names, scores.tolist(), strict=True)]

    return judge


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    return filter_texts(docs, _judge(train(docs.where(_remainder(3) != 1), sample)))
