"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from mistveil.llm import suffix_array
from mistveil.llm.suffix_array import Sizes
from tests.conftest import SF


def plain(docs, length=100):
    """docs: (doc_id, bytes) in order. What is removed of each, by a dictionary of all strings."""
    seen, out = set(), []
    for doc_id, data in docs:
        cover = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                cover[i : i + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((doc_id, len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def check(spark, rows, **sizes):
    """rows: (doc_id, text) in order of doc_id, without two different texts of one doc_id."""
    got = suffix_array.digest(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, `row` int").repartition(5), Sizes(**sizes)).collect()
    want = plain([(i, (t or "").encode()) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))], sizes.get("length", 100))
    assert ordered(tuple(r) for r in got) == ordered(want)
    return want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, hot = prose(60), prose(40)
    out = [(None, passage + prose(30)), (1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "b" * 99 + "a" * 101), (6, "ab" * 300), (7, "ab" * 50)]
    for i in range(8, 120):
        kind = i % 7
        text = prose(rng.randint(1, 150))
        if kind == 1:
            text += passage + prose(20)
        elif kind == 2:
            text = out[rng.randrange(8, len(out))][1] if len(out) > 9 else text
        elif kind == 3:
            text = hot[rng.randint(0, 60) :] + text + hot
        elif kind == 4:
            text += text[-120:] + prose(2) + text[:130]
        out.append((i, text))
    out.append((119, out[-1][1]))  # a repeated row
    return out


def test_difference_cover():
    shifts = {(a - b) % suffix_array.PERIOD for a in suffix_array.COVER for b in suffix_array.COVER}
    assert shifts == set(range(suffix_array.PERIOD))


def test_keys_are_hashed_and_sorted_once():
    """Both hashes in one pass, and keys that are equal in 64 of their 96 bits, against plain loops."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 400, np.uint8).tobytes()
    words, pos = suffix_array._words(data), rng.permutation(300)
    for lane, h in enumerate(suffix_array._mix_both(pos, words, 100)):
        assert (h == suffix_array._mix(pos, words, 100, lane)).all()
    for n, different in ((0, 1), (1, 1), (500, 40), (500, 1)):
        first, check = rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, different, n).astype(np.uint32)
        order, new, firsts = suffix_array._sorted_keys(first, check)
        keys = list(zip(first.tolist(), check.tolist()))
        assert [keys[i] for i in order] == sorted(keys) or different == 1 and sorted(order.tolist()) == list(range(n))
        assert [keys[i] for i in firsts] == sorted(set(keys)) and all(keys.index(keys[i]) == i for i in firsts.tolist()) and new.sum() == len(set(keys))
        full = np.empty(n, suffix_array._SUFFIX)
        full["key"], full["check"] = first, check
        assert suffix_array._not_first([full[:200].tobytes(), full[200:].tobytes()]).tolist() == [keys.index(k) < i for i, k in enumerate(keys)]


def test_small_chunks_and_buckets(spark, rows):
    """Pieces of long documents, many chunks, buckets and turns give what one dictionary gives."""
    want = check(spark, rows, chunk=1000, bucket=64, share=0.2)
    assert sum(r[2] for r in want) > 10_000 and any(r[3] > 1 for r in want)


def test_whole(spark, rows):
    check(spark, rows)


def test_other_length_and_alignment(spark, rows):
    check(spark, rows[:60], length=47, chunk=400, bucket=50)
    rng = random.Random(5)
    core = bytes(rng.choice(b"abcdefgh") for _ in range(100)).decode()
    for cut in (99, 100):  # strings that just miss and just reach the length, at every shift of both sides
        check(spark, [(i, "".join(rng.choice("xyz") for _ in range(i)) + core[:cut] + "".join(rng.choice("uvw") for _ in range(40))) for i in range(64)], chunk=500)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.digest(none).count() == 0
    got = suffix_array.digest(spark.createDataFrame([(1, None), (None, "short")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in got} == {(1, 0, 0), (None, 5, 0)}


def test_long_repetitive_text(spark):
    """A text of several pieces that repeats itself: all but its first period goes, in one span."""
    unit = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(200))
    text = unit * (3_000_000 // len(unit))
    r = suffix_array.digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), Sizes(chunk=1 << 18)).first()
    assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), len(text) - len(unit), 1)


def test_given_documents(spark):
    """The texts themselves come back, and the query's rows are those of brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.doc_id, (r.text or "").encode()) for r in docs.orderBy("doc_id").collect()])
    assert ordered(tuple(r) for r in suffix_array.digest(docs).collect()) == ordered(want)
