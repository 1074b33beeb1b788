"""Null and repeated ids, long texts, many languages and folders that can't be shared."""

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from mistveil.llm import langid, near_copies, packing, shared, token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_rows_without_doc_id(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (5, "x y"), (5, "z"), (-1, "")], "doc_id long, text string")
    packed = packing.pack(docs, VOCABULARY).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packed) == [(False, -1), (False, 5), (False, 5), (True, 0), (True, 0)]
    got = token_files.round_trip(docs, VOCABULARY).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in packed)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)][:3] == [None, None, -1]


def test_ids_that_do_not_fit(spark, tmp_path):
    with pytest.raises(ValueError):
        token_files.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path), VOCABULARY, width=1)


def test_blocks_leave_no_ngram_out():
    text = ("Une phrase, encore une phrase. " * 40).encode()
    assert sorted(np.concatenate(list(langid.subword_blocks(text, 64)))) == sorted(langid.subwords(text))


def test_every_language_is_learnt(spark):
    names = [f"{a}{b}" for a in "abcdefg" for b in "klmnopqrst"]
    rows = [(70 * i + k, f"{x}{x} {x}{'xyz'[i % 3]} {x}{x}{x} " * 6, x) for i in range(6) for k, x in enumerate(names)]
    docs = spark.createDataFrame([*rows, (10**6, rows[0][1], rows[0][2]), (10**6, rows[0][1], rows[0][2])], "doc_id long, text string, lang string")
    assert set(langid.train(docs).languages) == set(names)


def test_near_copies_of_rows_without_doc_id(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (3, "one two three four five six"), (4, "one two three four five six")], "doc_id long, text string").withColumn("__gone", F.lit(1))
    assert {r.doc_id for r in near_copies.deduplicate(docs).collect()} == {None, 3}


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        shared.scratch_root(Unset)
