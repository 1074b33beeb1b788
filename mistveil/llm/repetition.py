"""Quality rules by repetition coverage: rolling hashes of n-grams and lines over whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filter_texts, small_batches, utf8

#: Words of the window of n_repeat_words; least words; most repeated words in a hundred.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of a text's characters (of words) that may lie in n-grams met before, by n; and in lines met before.
MOST_COVERED = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
MOST_LINE_CHARS = 0.30
#: Marks of the noise class that a text may have for each word.
MOST_SYMBOLS = 0.10
SYMBOLS = b"#*$%&|<>"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span: differences of one prefix sum of value * base**i, moved back to the start."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, n), dtype=np.uint64, out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the key was met before, the key comes twice or more)"""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return later, any_


def _covered(marks: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of `length` items lie in a marked window of n items."""
    edge = np.zeros(length + 1, np.int64)
    edge[: len(marks)] += marks
    edge[n : n + len(marks)] -= marks
    return np.cumsum(edge[:length]) > 0


def measure(text: bytes, orders: tuple[int, ...] = tuple(MOST_COVERED)) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, and characters in repeated n-grams by order.

    The last two count code points of words, in lines equal to an earlier line, and in n-grams equal to an earlier n-gram.
    """
    b = np.frombuffer(text, np.uint8)
    space = _SPACE[b]
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(starts)
    symbols = int(_SYMBOL[b].sum())
    if not n:
        return (0, 0, symbols, 0, 0, 0, *[0] * len(orders))
    chars = np.concatenate([[0], np.cumsum(((b & 0xC0) != 0x80) & ~space)])
    words = _spans_hash(b.astype(np.uint64) + np.uint64(1), starts, ends)
    each = chars[ends] - chars[starts]
    breaks = np.flatnonzero(b == 10)
    from_, to = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(b)]])
    line_chars = chars[to] - chars[from_]
    full = line_chars > 0
    from_, to, line_chars = from_[full], to[full], line_chars[full]
    later, _ = _earlier(_spans_hash(b.astype(np.uint64) + np.uint64(1), from_, to))
    covered, repeated = [], 0
    for k in sorted({*orders, WINDOW}):
        if n < k + 1:
            covered += [0] * (k in orders)
            continue
        at = np.arange(n - k + 1)
        before, any_ = _earlier(_spans_hash(words, at, at + k))
        if k == WINDOW:
            repeated = int(_covered(any_, k, n).sum())
        if k in orders:
            covered.append(int(each[_covered(before, k, n)].sum()))
    return (n, int(chars[-1]), symbols, int(later.sum()), repeated, int(line_chars[later].sum()), *covered)


def verdict(row: tuple, orders: tuple[int, ...] = tuple(MOST_COVERED)) -> tuple[bool, bool]:
    """(base_failed, kept) of what `measure` gives."""
    n, chars, symbols, _, repeated, line_chars, *covered = row
    base_failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    good = line_chars <= MOST_LINE_CHARS * chars and symbols <= MOST_SYMBOLS * n and all(c <= MOST_COVERED[k] * chars for k, c in zip(orders, covered, strict=True))
    return base_failed, not base_failed and good


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = tuple(MOST_COVERED)
    for batch in batches:
        rows = []
        for t in utf8(batch.column(1)):
            m = measure(t, orders)
            rows.append((*m[:5], *verdict(m, orders), m[5], *m[6:]))
        columns = list(zip(*rows, strict=True)) or [[]] * (8 + len(orders))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *(f"dup_{k}gram_chars" for k in orders)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in zip(names, columns, strict=True)})


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): the counts of `measure` and the verdict of `verdict`.

    base_failed: under 20 words, or over 30 in a hundred words lie in 8-word windows that the text has twice or more. kept:
    not base_failed, and the characters in n-grams of 5 to 10 words and in lines that the text had before, and the noise
    marks for each word, stay under the module's shares. Null and empty texts have no words and fail; repeated rows and doc_ids come back as
    often as they are; an empty table gives no rows; other columns are ignored. Whole texts, one row at a time: no shuffle.
    """
    orders = ", ".join(f"dup_{k}gram_chars long" for k in MOST_COVERED)
    schema = f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, {orders}"
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_rules, schema)


def _judge(texts: list[bytes]) -> list[bool]:
    return [verdict(measure(t))[1] for t in texts]


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that `quality_rules` keeps, with all their columns."""
    return filter_texts(docs, _judge)
