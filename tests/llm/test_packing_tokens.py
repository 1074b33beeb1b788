"""Packing, token files and byte-level BPE against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from mistveil.llm import bpe, packing, token_files
from mistveil.llm.word_encoder import WordEncoder

P = pytest.importorskip("public_tokenizers")
WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "\n\t", None, "á x", "<|endoftext|>foo <|ENDOFTEXT|>", "ΑΣ ΟΔΥΣΣΕΥΣ.", "İstanbul ǅ ẞ", "x y z", "\x1c\x1d a\x1eb", "日本語テキスト", "'s IT'S can't.", "a\x00b", "😀👍🏽 ok", "FOO!! a.,b foo., -- a-",
    "word " * 9000, "a" * 70000, "1 \n  \n x" * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "extra", i) for i, t in enumerate(ODD)] + [(0, "again", "extra", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, bin string, start int")


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


def test_word_encoder_is_the_tokenizer():
    e = WordEncoder(WORDS)
    for _ in range(2):
        ids, counts = e.encode([(t or "").encode() for t in ODD])
        at = 0
        for t, n in zip(ODD, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == plain(t)
            at += n


def test_best_fit():
    rng = random.Random(1)
    lengths = np.array([rng.randrange(1, 101) for _ in range(500)])
    bins, places, loads = packing.best_fit(lengths, 100)
    assert loads.max() <= 100 and (np.bincount(bins, lengths) == loads).all()
    assert len(loads) <= 1.05 * np.ceil(lengths.sum() / 100) and (loads * 2 <= 100).sum() <= 1
    assert packing.best_fit(np.array([60, 40, 60, 40]), 100)[2].tolist() == [100, 100]


def packed(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return by


def test_pack(spark, docs):
    for parts in (1, 5):
        rows = packing.pack(docs.repartition(parts), WORDS).collect()
        expected = sorted((i * 3, k, s, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, ids in enumerate([*map(plain, ODD)]) for k, s in enumerate(range(0, len(ids) + 1, 4096)) for c in [(ids + [1])[s : s + 4096]])
        again = plain("again") + [1]
        expected = sorted([*expected, (0, 0, 0, len(again), zlib.crc32(np.array(again, "<u4").tobytes()))])
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
        total = sum(r.length for r in rows)
        assert len(packed(rows)) <= -(-total // 4096) + 1
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_tree_merges_underfull_bins(spark):
    small = spark.createDataFrame([(i, "one two three") for i in range(120)], "doc_id long, text string").repartition(40)
    assert len(packed(packing.pack(small, WORDS, fan=3).collect())) == 1


def test_token_files(spark, docs, tmp_path):
    manifest = token_files.write(docs, str(tmp_path / "t"), WORDS, n_files=3)
    rows = token_files.read(spark, str(tmp_path / "t")).collect()
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows) == len(ODD) + 1
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in rows)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    for r in rows:
        if r.doc_id:
            ids = plain(ODD[r.doc_id // 3]) + [1]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_files.round_trip(docs.limit(0), WORDS).count() == 0


def test_byte_bpe(spark, docs):
    for chunk, overlap in ((32_768, 512), (300, 40)):
        rows = {(r.doc_id, r.n_tokens): r for r in bpe.encode_and_decode(docs, RANKS, P.PATTERN, chunk, overlap).collect()}
        assert len(rows) == len(ODD) + 1
        for i, t in [*enumerate(ODD), (0, "again")]:
            ids = bpe.encode([t or ""], RANKS, P.PATTERN)[0]
            r = rows[i * 3, len(ids)]
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
            assert bpe.decode([ids], RANKS, P.PATTERN)[0] == (t or "").encode()


def test_stitch_stops_where_scans_disagree():
    assert bpe.stitch([(0, 10, [], [8, 9]), (7, 17, [8, 9], [15]), (14, 20, [16], [])]) == ([8], False)
    assert bpe.stitch([(0, 10, [], [8, 9]), (7, 17, [8, 9], [])]) == ([8], True)


def test_runs_without_a_boundary(spark):
    """A text of 1 MB with 2,000 blanks in an overlap, and one with a word of 40,000 letters: cut on both sides of these, encoded as a whole."""
    import public_tokenizers
    import tiktoken

    words = "some words, and more of them; " * 40_000
    texts = [words[:32_200] + " " * 2000 + words[:1_000_000], words[:50_000] + "a" * 40_000 + words[:300_000], words[:100_000]]
    long = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, row long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cuts = {r.row: r.cuts for r in bpe.cut_places(long, path, public_tokenizers.PATTERN, bpe.CHUNK, bpe.OVERLAP).collect()}
    assert cuts.keys() == {0, 1, 2}
    longest = {i: max(b - a for a, b in zip([0, *c], [*c, len(texts[i])], strict=True)) for i, c in cuts.items()}
    assert longest[0] < 3 * bpe.CHUNK and longest[1] < 20 * bpe.CHUNK and longest[2] < 2 * bpe.CHUNK
    encoding = bpe.codec(path, public_tokenizers.PATTERN)[0]
    assert isinstance(encoding, tiktoken.Encoding)
    for i, c in cuts.items():
        parts = [texts[i][a:b] for a, b in zip([0, *c], [*c, len(texts[i])], strict=True)]
        assert [x for p in parts for x in encoding.encode_ordinary(p)] == encoding.encode_ordinary(texts[i])
