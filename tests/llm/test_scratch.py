"""Scratch tables: what a query's result doesn't read is deleted."""

import os

import pytest

from mistveil.llm import queries
from mistveil.llm.shared import Owner, cut, scratch_root
from tests.conftest import SF


def tables(spark):
    return set(os.listdir(scratch_root(spark).removeprefix("file://")))


@pytest.mark.parametrize("name", ["op1_rp_forest", "op5_simhash", "op7_best_fit_packing", "op8_byte_bpe", "op10_token_files", "op11_suffix_array_dedup", "op12_conversation_trie"])
def test_one_table_is_left(spark, name):
    before = tables(spark)
    rows = queries.queries()[name](spark, SF)
    assert len(tables(spark) - before) == 1 and rows.count() > 0


def test_owners(spark):
    before = tables(spark)
    with Owner(spark) as outer:
        with Owner(spark) as inner:
            kept = inner.result(cut(spark.range(5), "a").where("id > 1"), "kept")
        assert len(tables(spark) - before) == 1 and kept.count() == 3
        last = outer.only(kept.where("id > 2"), "last")
        assert len(tables(spark) - before) == 1 and last.count() == 2
        result = outer.result(last, "result")
    assert len(tables(spark) - before) == 1 and result.count() == 2
    with pytest.raises(ZeroDivisionError), Owner(spark):
        cut(spark.range(5), "a")
        1 / 0  # noqa: B018
    assert len(tables(spark) - before) == 1
