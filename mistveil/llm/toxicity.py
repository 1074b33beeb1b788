"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in rounds over all labelled texts, with thresholds by language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, blocks, shuffles_freed, small, small_batches, utf8

#: Buckets of the word hash, size of an embedding, filter widths and filters of each width. Buckets met in fewer labelled texts
#: than LEAST_TEXTS share the embedding of the padding, which is zero: rare words tell nothing.
BUCKETS, SIZE, WIDTHS, FILTERS, LEAST_TEXTS = 1 << 18, 8, (1, 2, 3), 8, 4
#: Labelled documents of a part, which one task learns from in a round. Rounds, each over all rows: enough for ROWS_TO_READ rows.
PART, FEWEST_ROUNDS, MOST_ROUNDS, ROWS_TO_READ = 4096, 3, 12, 30_000
BATCH, RATE, DECAY, SEED = 16, 0.05, 1e-4, 11
#: Logits are counted up to this size and in this many cells for each 1 (rounded to them for thresholds and the slope).
MOST_LOGIT, LOGIT_CELLS = 32, 1024
#: Words whose buckets a worker keeps; words that are convolved at once.
CACHED_WORDS, STEP = 500_000, 1 << 16
#: Pseudo-documents that pull the first guess of a word's weight to none; languages with fewer held-back rows share a threshold.
PRIOR, LEAST_ROWS = 2.0, 30
#: For the thresholds, toxic texts count as this share of all at least: a missed one weighs as three clean ones flagged.
LEAST_SHARE = 0.25

_NOT_WORD = re.compile(rb"[^a-z\x80-\xff]+")


class _Buckets(dict):
    """Bucket of each word; computed where it is missing."""

    def __missing__(self, word: bytes) -> int:
        b = zlib.crc32(word) % (BUCKETS - 1) + 1  # 0 pads
        if len(self) < CACHED_WORDS:
            self[word] = b
        return b


_buckets = _Buckets()


def word_buckets(text: bytes) -> np.ndarray:
    """Hash buckets of the words of a text: runs of letters, ASCII lower-cased; other marks separate."""
    words = _NOT_WORD.sub(b" ", text.lower()).split()
    return np.fromiter(map(_buckets.__getitem__, words), np.int32, len(words))


@dataclass
class ToxicityModel:
    """responses: for each width, (position, row, filter): what a word at that position adds to the filters."""

    row: np.ndarray  # of each bucket, in responses
    responses: list[np.ndarray]
    filter_bias: list[np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float
    offset: dict[str, float]

    def pooled(self, words: np.ndarray) -> np.ndarray:
        """Largest value of each filter over all positions, at least 0. Padding lets short texts fill a window."""
        out, words = [], self.row[words]
        for r, b in zip(self.responses, self.filter_bias, strict=True):
            width = len(r)
            padded = np.concatenate([words, np.zeros(width - 1, np.int32)])
            most = np.zeros(len(b), np.float32)
            for at in range(0, len(words), STEP):
                own = padded[at : at + STEP + width - 1]
                z = r[0][own[: len(own) - width + 1]]
                for k in range(1, width):
                    z = z + r[k][own[k : len(own) - width + 1 + k]]
                np.maximum(most, z.max(axis=0) + b, out=most)
            out.append(most)
        return np.concatenate(out)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.pooled(word_buckets(t)) @ self.weights + self.bias for t in texts], np.float64)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated so that the pooled threshold is at 0.5."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.logits(texts) - self.offset[""]), -60, 60)))

    def threshold(self, lang: str | None) -> float:
        """The score from which a text of this language counts as toxic."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.offset.get(lang or "", self.offset[""]) - self.offset[""]), -60, 60))))


def _first_guess(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a toxic text given that it holds the word, shrunk to 0 for words of few texts. seen: texts by class and word; n: by class."""
    share = min(1 - 1e-3, max(1e-3, n[1] / max(1, n.sum())))
    pull = PRIOR * np.array([1 - share, share])
    odds = np.log((seen[1] + pull[1]) / (seen[0] + pull[0])) - np.log(share / (1 - share))
    return odds.astype(np.float32)


#: Matrices of the filters: width and place in the window of each.
_SLOTS = [(w, k) for w in WIDTHS for k in range(w)]
#: A model is one table of rows of SIZE numbers: the embeddings, then the filters, their biases, the output weights and its bias.
_DENSE = len(_SLOTS) * SIZE + 2 * len(WIDTHS) + 1
#: Steps of 1 in the sums of what parts of the rows taught: whole numbers, so the sums don't hang on their order.
_UNIT = 1 << 24


def _parts_of(model: np.ndarray) -> tuple[np.ndarray, ...]:
    """Views of a model's table: embeddings, filters (slot, size, filter), filter biases, output weights, output bias."""
    n = len(model) - _DENSE
    at = n + len(_SLOTS) * SIZE
    return model[:n], model[n:at].reshape(len(_SLOTS), SIZE, FILTERS), model[at : at + len(WIDTHS)].reshape(-1), model[at + len(WIDTHS) : -1].reshape(-1), model[-1]


def _new_model(guess: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    model = np.zeros((len(guess) + 1 + _DENSE, SIZE), np.float32)
    embedding, filters, fbias, weights, bias = _parts_of(model)
    embedding[1:] = rng.normal(0, 0.02, (len(guess), SIZE))
    embedding[1:, 0] = guess
    for f, (w, _) in zip(filters, _SLOTS, strict=True):
        f[:] = rng.normal(0, 0.1, f.shape)
        f[0, :] += 0.6 / w
    fbias[:], weights[:], bias[0] = -0.5, rng.normal(0.2, 0.05, len(weights)), -1.0
    return model


def _windows(embedding: np.ndarray, filters: np.ndarray, segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's largest value of each filter without its bias, and the words of the first window that has it.

    A segment ends in max(WIDTHS) - 1 words at which no window starts.
    """
    more, words = max(WIDTHS) - 1, np.concatenate(segments)
    r, n = filters.transpose(0, 2, 1).reshape(-1, SIZE) @ embedding[words].T, len(words) - more
    z = np.zeros((FILTERS * len(WIDTHS), n), np.float32)
    for j, (w, k) in enumerate(_SLOTS):
        z[(w - 1) * FILTERS : w * FILTERS] += r[j * FILTERS : (j + 1) * FILTERS, k : k + n]
    first, start = np.empty((len(segments), len(z)), np.int64), 0
    for at, segment in zip(first, segments, strict=True):
        at[:] = z[:, start : start + len(segment) - more].argmax(axis=1) + start
        start += len(segment)
    return z[np.arange(len(z)), first], words[first[:, :, None] + np.arange(more + 1)]


def _tops(embedding: np.ndarray, filters: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """_windows of whole texts; long ones are read in strips, so that STEP words are held at once, or BATCH short texts."""
    more, strips = max(WIDTHS) - 1, []
    for i, d in enumerate(docs):
        padded = np.concatenate([d if len(d) else np.zeros(1, np.int32), np.zeros(more, np.int32)])
        strips += [(i, padded[at : at + STEP + more]) for at in range(0, len(padded) - more, STEP)]
    top = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    found = np.zeros((*top.shape, more + 1), np.int32)
    while strips:
        size = np.cumsum([len(x) for _, x in strips])
        now = max(1, int(np.searchsorted(size, STEP, "right")))
        values, words = _windows(embedding, filters, [x for _, x in strips[:now]])
        for (i, _), v, x in zip(strips[:now], values, words, strict=True):
            better = v > top[i]
            top[i][better], found[i][better] = v[better], x[better]
        strips = strips[now:]
    return top, found


def _learn(model: np.ndarray, touched: np.ndarray, docs: list[np.ndarray], y: np.ndarray, rate: float, positive: float) -> None:
    """One step of gradient descent over embeddings, filters and output weights; the gradient goes through the largest position."""
    embedding, filters, fbias, weights, bias = _parts_of(model)
    top, words = _tops(embedding, filters, docs)
    v = top + fbias
    h = np.maximum(v, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ weights + bias[0], -30, 30)))
    d = ((p - y) * np.where(y == 1, positive, 1.0)).astype(np.float32)
    back = d[:, None] * weights * (v > 0)
    n = len(docs) * (1 + positive) / 2
    ids, steps, changes = [], [], []
    for (w, k), f in zip(_SLOTS, filters, strict=True):
        columns = slice((w - 1) * FILTERS, w * FILTERS)
        own, at = back[:, columns], words[:, columns, k]
        ids.append(at.ravel())
        steps.append((own[:, :, None] * f.T).reshape(-1, SIZE))
        changes.append(np.einsum("dfs,df->sf", embedding[at], own))
    for f, g in zip(filters, changes, strict=True):
        f -= rate * (g / n + DECAY * f)
    fbias -= rate * back.sum(axis=0) / n
    weights -= rate * ((d @ h) / n + DECAY * weights)
    bias[0] -= rate * d.sum() / n
    ids, steps = np.concatenate(ids), np.concatenate(steps)
    live = (ids > 0) & steps.any(axis=1)
    np.subtract.at(embedding, ids[live], (rate / n) * steps[live])
    np.add.at(touched, ids[live], 1)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str | None, np.ndarray]]:
    """part, toxic, lang and words of each document; one that is repeated comes once."""
    last = None
    for batch in batches:
        for part, doc_id, toxic, lang, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (part, doc_id) != last:
                last = part, doc_id
                yield part, toxic, lang, np.frombuffer(words, "<i4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each half and class that hold a bucket; bucket -1: all of them."""
    seen = np.zeros((2, 2, BUCKETS + 1), np.int64)
    for part, toxic, _, words in _training_rows(batches):
        seen[part % 2, toxic, np.unique(words)] += 1
        seen[part % 2, toxic, -1] += 1
    buckets = np.flatnonzero(seen.any(axis=(0, 1)))
    columns = seen[:, :, buckets].reshape(4, -1)
    buckets[buckets == BUCKETS] = -1
    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *(pa.array(c) for c in columns)], names=["bucket", *_COUNTS])


_COUNTS, _VALUES = ["n00", "n01", "n10", "n11"], [f"v{i}" for i in range(SIZE)]
_TAUGHT = "model int, row int, weight long, " + ", ".join(f"{v} long" for v in _VALUES)


def _round(shared, rate: float):
    """What each part of the rows teaches the model of all rows and that of its half: changes times their weight, in _UNITs."""

    def taught(model: int, before: np.ndarray, now: np.ndarray, touched: np.ndarray, rows: int) -> pa.RecordBatch:
        weight = np.concatenate([touched, np.full(_DENSE, rows, np.int64)])
        at = np.flatnonzero(weight)
        change = np.rint((now[at].astype(np.float64) - before[at]) * weight[at, None] * _UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, np.int32)), pa.array(at.astype(np.int32)), pa.array(weight[at]), *(pa.array(c) for c in change.T)], names=["model", "row", "weight", *_VALUES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, models, positive = shared.value
        for part, rows in groupby(_training_rows(batches), key=lambda r: r[0]):
            own = (0, 1 + part % 2)
            now, touched, n = [models[m].copy() for m in own], [np.zeros(len(models[0]) - _DENSE, np.int64) for _ in own], 0
            while batch := list(islice(rows, BATCH)):
                docs, y = [row[words] for _, _, _, words in batch], np.array([toxic for _, toxic, _, _ in batch])
                for m, model, t in zip(own, now, touched, strict=True):
                    _learn(model, t, docs, y, rate, positive[m])
                n += len(batch)
            for m, model, t in zip(own, now, touched, strict=True):
                yield taught(m, models[m], model, t, n)

    return run


def _model(row: np.ndarray, table: np.ndarray) -> ToxicityModel:
    embedding, filters, fbias, weights, bias = _parts_of(table)
    responses = [np.stack([embedding @ f for f, (w, _) in zip(filters, _SLOTS, strict=True) if w == width]) for width in WIDTHS]
    return ToxicityModel(row, responses, list(fbias.reshape(len(WIDTHS), FILTERS)), weights, float(bias[0]), 1.0, {"": 0.0})


def _logits_of_others(judges):
    """lang, toxic and rounded logit of each training row, by the model that has not seen its half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = judges.value
        rows = _training_rows(batches)
        while some := list(islice(rows, 1000)):
            z = [m.pooled(words) @ m.weights + m.bias for m, words in ((models[part % 2], words) for part, _, _, words in some)]
            cells = np.rint(np.clip(z, -MOST_LOGIT, MOST_LOGIT) * LOGIT_CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in some], pa.string()), pa.array([x[1] for x in some], pa.int32()), pa.array(cells)], names=["lang", "toxic", "cell"])

    return run


def _best_cut(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray, share: float) -> float:
    """The cut between logits that gets most labels right where `share` of all texts is toxic; the middle of the best gap.

    z: distinct logits in order; clean, toxic: how many rows of each class have it.
    """
    missed, flagged = np.concatenate([[0], np.cumsum(toxic)]), np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    wrong = share * missed / max(1, toxic.sum()) + (1 - share) * flagged / max(1, clean.sum())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(edges[best[len(best) // 2]])


def _cut_of_lang(share: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        z, clean, toxic = (table.column(c).to_numpy() for c in ("cell", "clean", "toxic"))
        some = clean.sum() + toxic.sum() >= LEAST_ROWS and clean.sum() and toxic.sum()
        return pa.table({"lang": table.column("lang")[: int(bool(some))], "cut": pa.array([_best_cut(z / LOGIT_CELLS, clean, toxic, share)] if some else [], pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from all labels (doc_id, toxic) and the texts of docs (doc_id, text, lang) that have one.

    The rows are dealt by a hash of doc_id into parts of about PART documents. In each round a part teaches its own copy of the model by
    gradient descent, and the copies' changes are averaged (embeddings: by how often a part moved them). Rounds go over all
    rows: FEWEST_ROUNDS, up to MOST_ROUNDS where there are few. Beside the model of all rows each half of the parts has one. It judges the other half, so that the
    slope, the threshold of all texts and that of each language with enough rows come from all rows, by a model that has not
    seen them (lang is used for these thresholds alone, never for a score). Only counts by bucket, the model and counts by
    rounded logit reach the driver, all of fixed size, and a threshold for each language.
    """
    spark = docs.sparkSession
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    with Scratch(spark) as scratch:
        labels = scratch.cut(labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic")), "toxic-labels")
        n_labels = labels.count()
        parts = 2 * max(1, -(-n_labels // (2 * PART)))
        texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        read = texts.join(small(labels, n_labels), "doc_id").select("doc_id", "toxic", "lang", "text").mapInArrow(_words, "doc_id long, toxic int, lang string, words binary")
        read = read.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "toxic", "lang", "words")
        order = ["part", F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "lang", "words"]
        rows = scratch.cut(read.repartition(parts, "part").sortWithinPartitions(*order), "toxic-words", one_group=True)

        got = rows.mapInArrow(_count, "bucket int, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _COUNTS))
        got = got.where(F.expr(f"bucket = -1 or {' + '.join(_COUNTS)} >= {LEAST_TEXTS}")).toArrow().sort_by("bucket")  # BUCKETS rows at most
        buckets, seen = got.column("bucket").to_numpy(), np.stack([got.column(c).to_numpy() for c in _COUNTS]).reshape(2, 2, -1)
        totals = seen[:, :, 0] if len(buckets) and buckets[0] == -1 else np.zeros((2, 2), np.int64)
        both = totals.sum(axis=0)
        if both.sum() < 4 or not both.all():
            share = float(both[1] / max(1, both.sum()))
            z = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
            return ToxicityModel(np.zeros(BUCKETS, np.int32), [np.zeros((1, 1, 1), np.float32)], [np.zeros(1, np.float32)], np.zeros(1, np.float32), z, 1.0, {"": 0.0})
        row = np.zeros(BUCKETS, np.int32)
        known = buckets > 0
        row[buckets[known]] = np.arange(1, known.sum() + 1)
        of = [(seen.sum(axis=0), both), *((seen[h], totals[h]) for h in (0, 1))]
        models = [_new_model(_first_guess(s[:, known], n)) for s, n in of]
        positive = [max(1.0, n[0] / max(1, n[1])) for _, n in of]
        for i in range(min(MOST_ROUNDS, max(FEWEST_ROUNDS, -(-ROWS_TO_READ // int(both.sum()))))):
            sent = spark.sparkContext.broadcast((row, models, positive))
            with shuffles_freed(spark):
                taught = rows.mapInArrow(_round(sent, RATE / (1 + 0.3 * i)), _TAUGHT).groupBy("model", "row").agg(F.sum("weight").alias("weight"), *(F.sum(v).alias(v) for v in _VALUES)).toArrow()
            sent.destroy()
            changes = np.stack([taught.column(v).to_numpy() for v in _VALUES], 1) / (taught.column("weight").to_numpy()[:, None] * float(_UNIT))
            of_model, at = taught.column("model").to_numpy(), taught.column("row").to_numpy()
            for m, model in enumerate(models):
                model[at[of_model == m]] += changes[of_model == m].astype(np.float32)

        model = _model(row, models[0])
        judges = [_model(row, models[2]), _model(row, models[1])] if totals.all() else [model, model]
        sent = spark.sparkContext.broadcast(judges)
        logits = rows.mapInArrow(_logits_of_others(sent), "lang string, toxic int, cell int")
        logits = scratch.cut(logits.groupBy("lang", "cell").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")), "toxic-logits")
        sent.destroy()
        every = logits.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow().sort_by("cell")  # 2 * MOST_LOGIT * LOGIT_CELLS + 1 rows at most
        z, clean, toxic = (every.column(c).to_numpy() for c in ("cell", "clean", "toxic"))
        z, share = z / LOGIT_CELLS, max(LEAST_SHARE, both[1] / both.sum())
        cut = _best_cut(z, clean, toxic, share)
        cuts = logits.where("lang is not null and lang <> ''").groupBy("lang").applyInArrow(_cut_of_lang(share), "lang string, cut double").collect()
    model.offset = {"": cut} | {r["lang"]: r["cut"] for r in cuts}
    losses = []
    for slope in np.geomspace(0.1, 20, 40):
        s = slope * (z - cut)
        losses.append((float(((clean + toxic) * np.logaddexp(0, s) - toxic * s).sum() / both.sum()), float(slope)))
    model.slope = min(losses)[1]
    return model


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [word_buckets(t).astype("<i4").tobytes() for t in utf8(batch.column(3))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(1), "lang": batch.column(2), "words": pa.array(own, pa.binary())})


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            scores = np.concatenate([np.zeros(0), *(model.value.scores(texts[part]) for part in blocks(texts))])
            limits = [model.value.threshold(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "flagged": pa.array(scores >= np.array(limits))})

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and flagged (score >= the language's threshold) of each document.

    docs: doc_id, text, lang; labels: doc_id, toxic. Learns only from labels whose crc32(doc_id) mod 5 is not 0; labels of
    other values than 0 and 1 or without a document teach nothing, a repeated doc_id counts once. Null and empty texts are scored
    as texts without words. Repeated documents come back as often as they are, an empty table gives no rows, other columns are
    ignored. The model (some MB, of fixed size) is broadcast.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(remainder != 0)))
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder == 0).alias("held_out"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, score double, predicted int, flagged boolean")
